"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (of the lower-cased text's UTF-8 bytes) that a whole text holds; a feature
counts once however often it occurs. For each feature the log ratio of its smoothed shares in the two classes is its
scale. Features that tell the classes apart best are kept, and a logistic regression is fitted on the scaled features.

The fit sees a bounded sample: at most ``per_class`` labelled rows of each class, chosen by a hash of the id, so the
model and what is collected or broadcast have a set size. Scores cover every row and whole texts.

Edge cases: null and empty texts have no feature and get the score of the intercept; rows without a label, a null label
or id are scored but never fitted; rows repeated in either table are fitted repeatedly; with fewer than one labelled row
of either class every score is the share of toxic labels (0.5 without any). Other columns are passed through, and a
column ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise


@dataclass(frozen=True)
class ToxicitySettings:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    kept: int = 2048
    alpha: float = 1.0
    per_class: int = 6000
    ridge: float = 3e-4
    steps: int = 100
    #: Tasks of the fit; each sends two counts per feature in blocks.
    tasks: int = 24
    block: int = 4096


def feature_ids(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed n-grams of the whole text, in no order, with repeats."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    found, rolled = [], np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        # The hash of n bytes is that of the first n - 1, times a constant, plus the next byte.
        rolled = rolled[:m] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in orders:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            found.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    settings: ToxicitySettings
    place: np.ndarray  # feature -> column of the kept features, or -1
    scale: np.ndarray  # by column: the log-count ratio
    weights: np.ndarray  # by column
    intercept: float

    def score(self, text: str | None) -> float:
        columns = self.place[feature_ids(text, self.settings.orders, self.settings.bits)]
        columns = np.unique(columns[columns >= 0])
        values = self.scale[columns]
        length = np.sqrt(values @ values)
        margin = self.intercept + (values @ self.weights[columns] / length if length > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def training_sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """(text, toxic) of at most ``per_class`` labelled rows of each class, by the hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(settings.per_class).unionByName(known.where("toxic = 0").orderBy(*order).limit(settings.per_class))
    chosen = materialise(chosen, "sample_ids")
    # At most 2 * per_class rows of two numbers.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.select("doc_id", "text", "toxic").repartition(settings.tasks, "doc_id")


def _counts(sample: DataFrame, s: ToxicitySettings) -> np.ndarray:
    """How many sampled texts of each class hold each feature: an array (2, features), and the texts of each class."""
    size = 1 << s.bits

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, texts, held = np.zeros((2, size), dtype=np.int64), np.zeros(2, dtype=np.int64), np.zeros(size, dtype=bool)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = feature_ids(text.as_py(), s.orders, s.bits)
                held[ids] = True
                seen[toxic][np.flatnonzero(held)] += 1
                held[ids] = False
                texts[toxic] += 1
        if texts.any():
            for at in range(0, size, s.block):
                part = seen[:, at : at + s.block]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "seen": pa.array([part.ravel().tolist()], pa.list_(pa.int64()))})
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1], pa.int32()), "seen": pa.array([texts.tolist()], pa.list_(pa.int64()))})

    def add(key, blocks):
        import pyarrow as pa

        total = sum(np.array(values) for values in blocks.column("seen").to_pylist())
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "seen": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = sample.select("text", "toxic").mapInArrow(count, "at int, seen array<long>")
    summed = parts.groupBy("at").applyInArrow(add, "at int, seen array<long>")
    seen, texts = np.zeros((2, size)), np.zeros(2)
    for row in summed.collect():  # the features are a fixed number
        if row["at"] < 0:
            texts = np.array(row["seen"], dtype=float)
        else:
            seen[:, row["at"] : row["at"] + s.block] = np.reshape(row["seen"], (2, -1))
    return seen, texts


def _fit_linear(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, scale: np.ndarray, s: ToxicitySettings) -> tuple[np.ndarray, float]:
    """Logistic regression with both classes of equal weight, by limited-memory quasi-Newton steps; (rows, columns) are
    the non-zero cells, and each row is scaled to length one."""
    n, k = len(labels), len(scale)
    values = scale[columns]
    values = values / np.maximum(np.sqrt(np.bincount(rows, values**2, n)), 1e-9)[rows]
    share, sign = labels.mean(), 2.0 * labels - 1
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (np.bincount(rows, values * at[columns], n) + at[k])
        error = -weight * sign / (1 + np.exp(np.clip(margin, -500, 500)))
        gradient = np.append(np.bincount(columns, values * error[rows], k) + s.ridge * at[:k], error.sum())
        return weight @ np.logaddexp(0, -margin) + 0.5 * s.ridge * (at[:k] @ at[:k]), gradient

    at = np.zeros(k + 1)
    value, gradient = loss(at)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(s.steps):
        way, used = gradient.copy(), []
        for move, change in memory[::-1]:
            used.append(move @ way / (move @ change))
            way -= used[-1] * change
        if memory:
            move, change = memory[-1]
            way *= move @ change / (change @ change)
        for (move, change), part in zip(memory, used[::-1], strict=True):
            way += (part - change @ way / (move @ change)) * move
        step, slope = 1.0, gradient @ way
        while True:
            after = at - step * way
            new_value, new_gradient = loss(after)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if new_value >= value:
            break
        move, change = after - at, new_gradient - gradient
        if move @ change > 1e-12:
            memory = [*memory, (move, change)][-10:]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        at, value, gradient = after, new_value, new_gradient
        if done:
            break
    return at[:k], float(at[k])


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (0 or 1), only rows to learn from."""
    s = settings or ToxicitySettings()
    sample = materialise(training_sample(docs, labels, s), "sample")
    seen, texts = _counts(sample, s)
    size = 1 << s.bits
    place = np.full(size, -1, dtype=np.int32)
    if not texts.all():
        share = float(np.clip(texts[1] / texts.sum(), 1e-6, 1 - 1e-6)) if texts.sum() else 0.5
        return Model(s, place, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    smoothed = (seen + s.alpha) / (texts[:, None] + 2 * s.alpha)
    ratio = np.log(smoothed[1] / smoothed[0])
    spread = np.sqrt((smoothed * (1 - smoothed) / texts[:, None]).sum(0))
    order = np.lexsort((np.arange(size), -np.abs(smoothed[1] - smoothed[0]) / spread))[: s.kept]
    place[order] = np.arange(len(order))

    def columns(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for text in batch.column(0):
                at = place[feature_ids(text.as_py(), s.orders, s.bits)]
                found.append(np.unique(at[at >= 0]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "columns"])

    cells = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(columns, "toxic int, columns array<int>").toArrow()
    lists = cells.column("columns").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    weights, intercept = _fit_linear(rows, lists.flatten().to_numpy(), cells.column("toxic").to_numpy(), ratio[order], s)
    return Model(s, place, ratio[order], weights, intercept)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: a place per feature, a weight per column

    def scored(texts):
        import pyarrow as pa

        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("score", F.arrow_udf(scored, "double")(F.col(text).cast("string")))
