"""Embedding whitening from exact cross-products of bit planes.

Entries become whole numbers x = floor(scale * c). The fit list holds each distinct x vector once (a shuffle of vectors in
their narrowest width, equal ones collapsed before it). Tasks cut it into blocks of a set number of rows; in a block each
dimension is shifted by its least value, and bit p of all rows of a dimension is packed into 64-bit words. The popcount
of two planes' AND, weighted by 2^(p+q), adds up to the exact sum of products; the shift is taken back in whole numbers.
Tasks send one row per pair of dimensions, as limbs that add up without overflow, so what reaches the driver grows with
the square of the dimension and not with the rows. The covariance is centred there in whole numbers before it becomes
double for ``eigh``.

Edge cases: rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors of another
length than the one most distinct vectors have (of equally frequent lengths, the longest). Entries beyond the range of a
long become its ends. Repeated rows keep a result each and count once in the fit. No vectors give no rows. A component
without variance is 0 in every row, which the identity error shows. Columns of the input stay, whatever their names;
those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.gram import group_moments
from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class WhiteningSettings:
    scale: float = 256.0
    components: int = 4
    #: Rows of a block, which bounds a task's memory.
    block_rows: int = 16384


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening. ``sums`` are whole numbers; ``axes`` are the components over the root of their variance."""

    n: int
    sums: tuple[int, ...]
    variances: tuple[float, ...]
    explained: tuple[float, ...]
    axes: np.ndarray


RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")

#: Whole numbers travel as limbs of 40 bits; the last one carries the sign.
LIMBS, LIMB_BITS = 5, 40
_LAST = np.iinfo(np.int64)


def quantised(entries: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * entries) as long, saturated."""
    with np.errstate(over="ignore"):
        x = np.floor(entries * scale)
    low, high = x <= float(_LAST.min), x >= -float(_LAST.min)
    out = np.where(low | high, 0.0, x).astype(np.int64)
    out[low], out[high] = _LAST.min, _LAST.max
    return out


def _vectors(column, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) per length of an Arrow list column, without vectors that are null or not finite throughout."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]])
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        values = entries[starts[rows][:, None] + np.arange(length)]
        whole = np.isfinite(values).all(1)
        yield rows[whole], quantised(values[whole], scale)


def _narrow(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest width that holds all of its entries; equal vectors give equal bytes."""
    out = np.empty(len(x), dtype=object)
    top = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1))
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = [row.tobytes() for row in x[rows].astype(f"<i{w}")]
    return list(out)


def _wide(codes: list[bytes], length: int) -> np.ndarray:
    return np.array([np.frombuffer(c, f"<i{len(c) // length}") for c in codes], dtype=np.int64).reshape(len(codes), length)


def fit_list(vectors: DataFrame, scale: float) -> DataFrame:
    """Each distinct x vector of ``_vector`` once: (length, code)."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for _, x in _vectors(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(_narrow(x), pa.binary())], names=["length", "code"])

    return vectors.select("_vector").mapInArrow(encode, "length int, code binary").distinct()


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value per dimension, and (plane, dimension, word): the bits of the shifted values, 64 rows to a word."""
    low = x.min(0)
    shifted = x.view(np.uint64) - low.view(np.uint64)
    words = -(-len(x) // 64)
    planes = np.zeros((int(shifted.max()).bit_length(), x.shape[1], words), np.uint64)
    for p in range(len(planes)):
        bits = np.packbits((shifted >> np.uint64(p) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        planes[p] = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, words * 8 - bits.shape[1])))).view(np.uint64)
    return low, planes


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns of x (long) as Python's whole numbers, by popcounts."""
    n, k = x.shape
    low, planes = bit_planes(x)
    vectors = planes.reshape(-1, planes.shape[2])
    counts = np.zeros((len(vectors), len(vectors)), np.int64)
    for a, vector in enumerate(vectors):
        counts[a, a:] = np.bitwise_count(vector & vectors[a:]).sum(1, dtype=np.int64)
        counts[a:, a] = counts[a, a:]
    counts = counts.reshape(len(planes), k, len(planes), k)
    by_weight = np.zeros((2 * len(planes), k, k), np.int64)
    ones = np.zeros(k, dtype=object)
    for p in range(len(planes)):
        ones += np.diagonal(counts[p, :, p, :]).astype(object) << p
        for q in range(len(planes)):
            by_weight[p + q] += counts[p, :, q, :]
    products = sum((m.astype(object) << s for s, m in enumerate(by_weight)), np.zeros((k, k), dtype=object))
    shift = low.astype(object)
    products = products + np.outer(shift, ones) + np.outer(ones, shift) + n * np.outer(shift, shift)
    return ones + n * shift, products


def limbs(values: np.ndarray) -> list[np.ndarray]:
    last = (LIMBS - 1) * LIMB_BITS
    parts = [(values >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [p.astype(np.int64) for p in [*parts, values >> last]]


def _scattered(codes: DataFrame, length: int, block_rows: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products over the fit list. Row i = -1 holds the number of rows, j = -1 the sums."""

    def fold(batches):
        import pyarrow as pa

        total: list = [0, np.zeros(length, dtype=object), np.zeros((length, length), dtype=object)]

        def add(held: list[bytes]) -> None:
            for at in range(0, len(held), block_rows):
                x = _wide(held[at : at + block_rows], length)
                sums, products = scatter(x)
                total[:] = total[0] + len(x), total[1] + sums, total[2] + products

        held: list[bytes] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= block_rows:
                add(held)
                held = []
        add(held)
        if total[0]:
            i, j = np.triu_indices(length)
            values = np.concatenate([[total[0]], total[1], total[2][i, j]]).astype(object)
            rows = np.concatenate([[-1], np.arange(length), i]).astype(np.int32)
            others = np.concatenate([[-1], np.full(length, -1), j]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (rows, others, *limbs(values))], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = codes.where(F.col("length") == length).select("code").mapInArrow(fold, schema)
    n, sums, products = 0, np.zeros(length, dtype=object), np.zeros((length, length), dtype=object)
    for row in parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect():  # dimension squared
        value = sum(row[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS))
        if row["i"] < 0:
            n = value
        elif row["j"] < 0:
            sums[row["i"]] = value
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = value
    return n, sums, products


def solved(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitening:
    """Components of the covariance, which is centred in whole numbers; its largest ``components`` variances."""
    k = len(sums)
    scatter_n = n * products - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in scatter_n.tolist()], float).reshape(k, k)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    floor = k * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    vectors = vectors[:, order] * np.where(np.abs(vectors[:, order]).max(0, initial=0) == vectors[:, order].max(0, initial=0), 1.0, -1.0)
    variances = [float(v) if v > floor else 0.0 for v in values[order]]
    axes = vectors / np.where(np.array(variances) > 0, np.sqrt(variances), np.inf)
    return Whitening(n, tuple(sums.tolist()), tuple(variances), tuple(v / trace if trace > 0 else 0.0 for v in variances), axes)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    n, sums, k = model.n, model.sums, max(x.shape[1], 1)
    reach = int(np.abs(x.astype(float)).max(initial=0.0)) + 1
    if (n * reach + max(map(abs, sums), default=0)) ** 2 * k < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, dtype=object)
    return (d * d).sum(1).tolist()


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows by components: x - S / n along the axes."""
    reach = int(np.abs(x.astype(float)).max(initial=0.0)) + 1
    if model.n * reach + max(map(abs, model.sums), default=0) < 1 << 53:
        centred = (model.n * x - np.array(model.sums, np.int64)) / model.n
    else:
        centred = x - np.array([s / model.n for s in model.sums])
    return centred @ model.axes


def identity_error(codes: DataFrame, length: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity; one pass over the list."""
    names = [f"z{c}" for c in range(model.axes.shape[1])]

    def whitened(batches):
        import pyarrow as pa

        for batch in batches:
            z = projected(_wide(batch.column(0).to_pylist(), length), model)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column)) for column in z.T], names=names)

    z = codes.where(F.col("length") == length).select("code").mapInArrow(whitened, ", ".join(f"{c} double" for c in names))
    row = group_moments(z, names, []).first()
    covariance = np.reshape(row["comoment"], (len(names), len(names))) / row["counts"][0]
    return float(np.abs(covariance - np.eye(len(names))).max())


def whiten(rows: DataFrame, vector: str = "embedding", settings: WhiteningSettings | None = None) -> DataFrame:
    """A row per row with a whole vector and per component (from 1, by falling variance): ``component``, ``n`` (distinct
    vectors), ``deviation`` (decimal, exact; null from 10^38), ``whitened``, ``explained`` and ``identity_error``."""
    s = settings or WhiteningSettings()
    table = packed(rows, {"_vector": F.col(f"`{vector}`").cast("array<double>")}, RESULTS)
    codes = materialise(fit_list(table, s.scale), "fit_list")
    lengths = codes.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    length = lengths["length"] if lengths else 0
    model = error = None
    if length:
        model = solved(*_scattered(codes, length, s.block_rows), s.components)
        error = identity_error(codes, length, model)
    schema = f"whole {table.schema['whole'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in _vectors(batch.column(1), s.scale):
                if not length or x.shape[1] != length or not len(x):
                    continue
                z, k = projected(x, model), model.axes.shape[1]
                far = [d if d < 10**38 else None for d in deviations(x, model)]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n, np.int64)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(z.ravel()),
                    pa.array(np.tile(np.array(model.explained), len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["whole", *RESULTS])

    return unpacked(table.mapInArrow(project, schema), rows, RESULTS, **{c: c for c in RESULTS})
