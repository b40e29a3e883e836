"""Secret scans: keyword prefilter, anchored expressions near the hits, checksums.

One Aho-Corasick pass over the lower-cased text finds where keywords begin. The expression of a keyword's kind is then
tried at that place only (anchored), matches of a kind do not overlap, and kinds with an embedded checksum or encoded
header are kept only if it is right. Runs of hexadecimal digits have no keyword; one linear pass finds them.

Edge cases: null and empty texts have no spans; texts are scanned whole whatever their length; repeated rows give
repeated results; other columns are passed through. Positions are code points, ends are exclusive. A column named
``spans`` in the input is replaced.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, the first three being the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "stripe", "slack", "google")
BASE = KINDS[:3]

#: Keyword -> kind whose expression starts there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "private_key",
    "sk_live_": "stripe", "rk_live_": "stripe", "xoxb-": "slack", "xoxp-": "slack", "xoxa-": "slack", "aiza": "google",
}

#: Expressions, tried at a keyword only.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "private_key": re.compile(r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"),
    "slack": re.compile(r"xox[bpa]-[0-9]{8,}-[0-9A-Za-z-]{16,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_checksum(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits, the check that tokens with a prefix carry at their end."""
    rest, digits = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = _BASE62[digit] + digits
    return digits


def _sum_is_right(match: re.Match) -> bool:
    body = match[0].partition("_")[2]
    return base62_checksum(body[:-6]) == body[-6:]


def _header_is_json(match: re.Match) -> bool:
    head = match[0].partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": _sum_is_right,
    "npm": _sum_is_right,
    "jwt": _header_is_json,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every secret, sorted."""
    if not text:
        return []
    # Lower-casing bytes changes A-Z only, so places stay the same.
    hits: dict[str, list[int]] = {}
    for last, (length, kind) in _automaton().iter(text.encode("utf-8", "replace").lower().decode()):
        hits.setdefault(kind, []).append(last + 1 - length)
    spans = [(m.start(), KINDS.index("hex"), m.end()) for m in PATTERNS["hex"].finditer(text)]
    for kind, starts in hits.items():
        pattern, valid, free = PATTERNS[kind], VALID.get(kind), 0
        for start in sorted(set(starts)):
            if start >= free and (match := pattern.match(text, start)):
                free = match.end()
                if valid is None or valid(match):
                    spans.append((start, KINDS.index(kind), free))
    return sorted(spans)


def _spans_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def _scan_column(texts):
    import pyarrow as pa

    found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in scan(t.as_py())] for t in texts]
    return pa.array(found, _spans_type())


def _redact_column(texts):
    import pyarrow as pa

    return pa.array([redact_text(t.as_py()) for t in texts], pa.string())


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = scan(text)
    if not spans:
        return text
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind]}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end), by start and then kind."""
    scanned = F.arrow_udf(_scan_column, "array<struct<start: bigint, kind: string, end: bigint>>")
    return docs.withColumn("spans", scanned(F.col(text).cast("string")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in the text replaced; clean texts stay as they are."""
    return docs.withColumn(text, F.arrow_udf(_redact_column, "string")(F.col(text).cast("string")))


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the chosen kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
