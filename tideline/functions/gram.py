"""Means and covariances of many columns per group in one vectorised pass.

Each task folds its rows into one matrix per group (numpy, by Arrow batch) and sends matrices, not rows. They are merged
in two rounds: first those of a group from every ``FAN`` tasks, then the results. A merging task reads its matrices in
order of their groups and holds one at a time, so neither a hot group nor many tasks fill its memory. A task that meets
many groups sends what it holds whenever that exceeds a set size.

``range_moments`` gives the matrices of ranges of positions that overlap, such as expanding train windows, from one matrix
per block of positions and the rows at the ranges' edges: rows are read once however many ranges hold them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles a task holds before it sends its matrices.
HELD = 4_000_000
#: Tasks whose matrices of a group are merged in the first round.
FAN = 64
PARTS = ["counts", "mean", "comoment", "square"]

State = tuple[np.ndarray, ...]  # counts, means, co-moments, sums of squares; each (k, k), by common rows of two columns


def _state(x: np.ndarray) -> State:
    """Entry (i, j) of each matrix is over the rows in which columns i and j are both present; means and squares are i's."""
    there = ~np.isnan(x)
    seen = there.astype(float)
    # Taking off a value that occurs first leaves exact zeros in a constant column.
    first = x[there.argmax(0), np.arange(x.shape[1])]
    z = np.where(there, x - first, 0.0)
    own = z.sum(0) / np.maximum(seen.sum(0), 1)
    z = np.where(there, z - own, 0.0)
    centre = np.where(there.any(0), first + own, 0.0)
    n = seen.T @ seen
    mean = np.divide(z.T @ seen, n, out=np.zeros_like(n), where=n > 0)
    return n, mean + centre[:, None], z.T @ z - n * mean * mean.T, (z * z).T @ seen - n * mean * mean


def _merged(a: State, b: State) -> State:
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    step = np.where(b[0] > 0, b[1] - a[1], 0.0)
    weight = a[0] * share
    mean = np.where(a[0] > 0, a[1] + step * share, b[1])
    step = np.where(a[0] > 0, step, 0.0)
    return n, mean, a[2] + b[2] + weight * step * step.T, a[3] + b[3] + weight * step * step


def _groups(keys) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, row numbers) of a batch's groups."""
    codes = keys.to_pandas().groupby(keys.schema.names, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield tuple(column[int(rows[0])].as_py() for column in keys.columns), rows


def _packed(names: Sequence[str], fields, held: list[tuple[tuple, State]], *more):
    """A batch of keys and matrices; ``more``: one further column."""
    import pyarrow as pa

    values = [pa.array([key[i] for key, _ in held], fields[i].type) for i in range(len(names))]
    values += [pa.array([state[p].ravel() for _, state in held], pa.list_(pa.float64())) for p in range(len(PARTS))]
    return pa.RecordBatch.from_arrays([*values, *(pa.array([v] * len(held), pa.int64()) for _, v in more)], names=[*names, *PARTS, *(c for c, _ in more)])


def _partial(rows: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(names, matrices, _task): those of each task and group, or several where the task held many groups."""
    k = len(columns)
    chosen = rows.select(*names, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])

    def fold(batches: Iterator) -> Iterator:
        held: dict[tuple, State] = {}
        fields, task = None, ("_task", TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(i) for i in range(len(names))]
            x = np.column_stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            for key, at in _groups(batch.select(list(range(len(names))))):
                state = _state(x[at])
                held[key] = _merged(held[key], state) if key in held else state
            if len(held) * len(PARTS) * k * k > HELD:
                yield _packed(names, fields, list(held.items()), task)
                held = {}
        if held:
            yield _packed(names, fields, list(held.items()), task)

    return chosen.mapInArrow(fold, f"{_schema(chosen, names)}, _task long")


def _schema(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"{p} array<double>" for p in PARTS)])


def _merge_round(parts: DataFrame, names: Sequence[str], by: Sequence[Column | str]) -> DataFrame:
    """Matrices of equal names in a partition merged one after the other; ``by`` deals them out."""

    def merge(batches: Iterator) -> Iterator:
        at = total = fields = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fields, done = [batch.schema.field(i) for i in range(len(names))], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)
            flat = [batch.column(len(names) + p) for p in range(len(PARTS))]
            size = int(round(len(flat[0][0]) ** 0.5))
            matrices = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size) for c in flat]
            for i, key in enumerate(keys):
                state = tuple(m[i] for m in matrices)
                if at == key:
                    total = _merged(total, state)
                    continue
                if at is not None:
                    done.append((at, total))
                at, total = key, state
            if done:
                yield _packed(names, fields, done)
        if at is not None:
            yield _packed(names, fields, [(at, total)])

    dealt = parts.repartition(*by).sortWithinPartitions(*by).select(*names, *PARTS)
    return dealt.mapInArrow(merge, _schema(parts, names))


def merged_moments(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per group of (names, matrices, _task)."""
    first = _merge_round(parts, names, [*names, F.floor(F.col("_task") / FAN)])
    return _merge_round(first, names, names)


def _whole(rows: DataFrame, columns: Sequence[str], needed: Sequence[str]) -> DataFrame:
    return rows.na.drop(subset=list(needed)) if needed else rows


def group_moments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], needed: Sequence[str] = ()) -> DataFrame:
    """(keys, counts, mean, comoment, square): flat k x k arrays over common rows of two columns.

    ``needed``: rows that lack one of these are left out. Without keys there is one group, and no row for no rows.
    """
    chosen = _whole(rows, columns, needed)
    names = list(keys) or ["_all"]
    chosen = chosen if keys else chosen.withColumn("_all", F.lit(None).cast("boolean"))
    return merged_moments(_partial(chosen, list(columns), names), names)


def range_moments(
    rows: DataFrame, ranges: DataFrame, columns: Sequence[str], keys: Sequence[str], name: str = "fold", lo: str = "train_lo", hi: str = "train_hi",
    needed: Sequence[str] = (), position: str = "rn", width: int = 512,
) -> DataFrame:
    """(keys, name, matrices) of every range [lo, hi) of positions that holds a row."""
    from tideline.operators.align import range_join

    keys, names = list(keys), [*keys, name]
    chosen = _whole(rows, columns, needed).select(*keys, position, *columns)
    first, last = F.ceil(F.col(lo) / width), F.floor(F.col(hi) / width)
    spans = ranges.filter(F.col(hi) > F.col(lo)).select(*names, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), first.alias("_first"), last.alias("_last"))
    inner = F.col("_first") < F.col("_last")
    blocks = group_moments(chosen.withColumn("_block", F.floor(F.col(position) / width)), columns, [*keys, "_block"])
    inside = spans.filter(inner).withColumn("_block", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)))
    # a task number per block spreads the first round of merging
    whole = inside.join(blocks, [*keys, "_block"]).select(*names, *PARTS, F.col("_block").cast("long").alias("_task"))
    edge = lambda a, b: F.struct(a.cast("long").alias("_a"), b.cast("long").alias("_b"))
    edges = F.when(inner, F.array(edge(F.col("_lo"), F.col("_first") * width), edge(F.col("_last") * width, F.col("_hi")))).otherwise(F.array(edge(F.col("_lo"), F.col("_hi"))))
    cut = spans.select(*names, F.explode(edges).alias("_e")).select(*names, "_e._a", "_e._b")
    at_edges = _partial(range_join(chosen, cut, keys, position, "_a", "_b", width), list(columns), names)
    return merged_moments(whole.unionByName(at_edges), names)
