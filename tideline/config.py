"""Run settings: plain dataclasses on the driver, read from nested JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class FeatureSettings:
    separation: int = 30
    rsi_period: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    atr_period: int = 14
    bollinger_period: int = 20
    bollinger_std: int = 2
    ma_short: int = 10
    ma_long: int = 50
    volatility_windows: tuple[int, ...] = (5, 10, 20)
    correlation_window: int = 30
    lags: tuple[int, ...] = (1, 2, 3, 5, 10)
    only_price_lags: bool = False
    regime_window: int = 60
    bull_threshold: float = 0.1
    bear_threshold: float = -0.1
    min_correlation: float = 0.01
    max_correlation: float = 0.95
    keep_high_correlation: bool = True
    use_log_target: bool = True
    log_epsilon: float = 1e-6


@dataclass(frozen=True)
class SplitSettings:
    """Walk-forward splits.

    The ``fixed`` strategy cuts up to ``n_splits`` test blocks of ``test_size`` rows from the end of a series, each after
    ``gap`` rows left out and all earlier rows as train rows (``expanding``) or as many as the first fold has. A forward
    target of h rows needs ``gap`` of at least h to keep train and test targets apart; the default target looks five rows
    ahead. ``max_train`` is a cap for those who want one.

    The ``adaptive`` strategy lets sizes follow the length n of a series by the numbers below.
    """

    n_splits: int = 5
    test_size: int = 252
    min_train: int = 60
    min_test: int = 20
    gap: int = 5
    max_train: int | None = None
    expanding: bool = True
    strategy: str = "fixed"
    #: adaptive: most splits at a length of at least so many rows, and below all of them
    length_steps: tuple[tuple[int, int], ...] = ((5000, 12), (2000, 8), (1000, 5), (500, 3))
    short_splits: int = 1
    #: adaptive: a test block is n / test_share rows, at most most_test; with one split it is n / single_share
    test_share: int = 10
    most_test: int = 504
    single_share: int = 5
    #: adaptive: the first train part is n / first_share rows, between the two bounds
    first_share: int = 8
    first_least: int = 126
    first_most: int = 756
    #: adaptive: rows kept for training when the number of blocks is worked out, at least
    reserve: int = 10


@dataclass(frozen=True)
class WindowSettings:
    """Fixed windows of the uniform comparison."""

    train: int = 200
    val: int = 60
    step: int = 60
    lookback: int = 10
    scaling: str = "standard"


@dataclass(frozen=True)
class Settings:
    assets: tuple[str, ...] = ()
    features: FeatureSettings = field(default_factory=FeatureSettings)
    splits: SplitSettings = field(default_factory=SplitSettings)
    windows: WindowSettings = field(default_factory=WindowSettings)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def _section(cls, values: dict):
    """Known fields only; integers below one fall back to the default, as do bad types."""
    base, out = cls(), {}
    for f in fields(cls):
        if f.name not in values:
            continue
        default, given = getattr(base, f.name), values[f.name]
        if isinstance(default, bool):
            out[f.name] = bool(given)
        elif default is None:
            out[f.name] = int(given) if isinstance(given, (int, float)) and int(given) >= 1 else None
        elif f.name == "length_steps":
            out[f.name] = tuple((int(n), int(k)) for n, k in given)
        elif isinstance(default, int):
            low = 0 if f.name in ("separation", "gap") else 1
            out[f.name] = int(given) if isinstance(given, (int, float)) and int(given) >= low else default
        elif isinstance(default, tuple):
            kept = tuple(int(v) for v in given if isinstance(v, (int, float)) and int(v) > 0)
            out[f.name] = kept or default
        else:
            out[f.name] = type(default)(given)
    return replace(base, **out)


def from_dict(values: dict) -> Settings:
    return Settings(
        assets=tuple(values.get("assets", ())),
        features=_section(FeatureSettings, values.get("features", {})),
        splits=_section(SplitSettings, values.get("splits", {})),
        windows=_section(WindowSettings, values.get("windows", {})),
    )


def from_file(path: str) -> Settings:
    with open(path, encoding="utf-8") as handle:
        return from_dict(json.load(handle))
