"""Recurrences along a series as associative scans, so that no task holds a series and no row waits for the one before.

A series is cut into chunks of a set number of positions, each one row of arrays. A chunk's effect on a state is itself a
small value: an affine map for a linear recurrence, a k x k matrix for a chain of hidden states. Tasks work these out
in parallel, one group per series runs through the chunks' effects (a row per chunk), and each chunk then starts from its
exact state. Results do not depend on the size of a chunk.

Inside a chunk the same is done once more with numpy: about sqrt(m) blocks of about sqrt(m) rows, all blocks at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a chunk.
SIZE = 16384


def position_chunks(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("asset",), position: str = "rn", size: int = SIZE) -> DataFrame:
    """(keys, chunk, position, columns): an array per column, rising by position; at most ``size`` rows each."""
    cells = F.struct(F.col(position).cast("bigint").alias(position), *columns)
    held = rows.groupBy(*keys, F.floor(F.col(position) / size).cast("bigint").alias("chunk")).agg(F.array_sort(F.collect_list(cells)).alias("_cells"))
    return held.select(*keys, "chunk", *(F.col(f"_cells.{c}").alias(c) for c in (position, *columns)))


def chunk_pieces(ranges: DataFrame, lo: str, hi: str, size: int = SIZE) -> DataFrame:
    """A row per range and chunk that it touches."""
    first, last = F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size)
    return ranges.filter(F.col(hi) > F.col(lo)).withColumn("chunk", F.explode(F.sequence(first, last)))


def listed(pieces: DataFrame, keys: Sequence[str], columns: Sequence[str | Column]) -> DataFrame:
    """(keys, chunk, pieces): the pieces that touch a chunk as one array."""
    return pieces.groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*columns)).alias("pieces"))


def _shape(m: int) -> tuple[int, int]:
    """Blocks and rows of a block."""
    steps = max(1, int(np.ceil(np.sqrt(m))))
    return -(-m // steps), steps


# ---- linear recurrences ---------------------------------------------------------------


def affine_path(start: np.ndarray, decay: np.ndarray, shift: np.ndarray, gain: np.ndarray, x: np.ndarray) -> np.ndarray:
    """v[0] = start, v[t + 1] = shift + gain x[t] + decay v[t]; (len(x) + 1, columns), the columns side by side."""
    m, (blocks, steps) = len(x), _shape(max(len(x), 1))
    padded = np.zeros(blocks * steps)
    padded[:m] = x
    padded = padded.reshape(blocks, steps)
    local = np.zeros((blocks, steps + 1, len(decay)))
    for t in range(steps):
        local[:, t + 1] = shift + gain * padded[:, t, None] + decay * local[:, t]
    powers = decay ** np.arange(steps + 1)[:, None]
    into = np.empty((blocks, len(decay)))
    into[0] = start
    for b in range(blocks - 1):
        into[b + 1] = powers[-1] * into[b] + local[b, -1]
    path = local[:, :steps] + powers[:steps] * into[:, None]
    last = powers[-1] * into[-1] + local[-1, -1]
    return np.concatenate([path.reshape(blocks * steps, -1), last[None]])[: m + 1]


# ---- chains of matrices ---------------------------------------------------------------

Reduce = Callable[[np.ndarray, int], np.ndarray]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def largest(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis)


def compose(a: np.ndarray, b: np.ndarray, reduce: Reduce) -> np.ndarray:
    """First a, then b: logs of matrix products, or their best paths."""
    return reduce(a[..., :, :, None] + b[..., None, :, :], -2)


def onward(v: np.ndarray, m: np.ndarray, reduce: Reduce) -> np.ndarray:
    return reduce(v[..., :, None] + m, -2)


def back(m: np.ndarray, v: np.ndarray, reduce: Reduce) -> np.ndarray:
    return reduce(m + v[..., None, :], -1)


def _blocked(m: np.ndarray) -> np.ndarray:
    """(blocks, steps, k, k), filled up with maps that change nothing."""
    blocks, steps = _shape(len(m))
    k = m.shape[1]
    none = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    fill = np.broadcast_to(none, (blocks * steps - len(m), k, k))
    return np.concatenate([m, fill]).reshape(blocks, steps, k, k)


def _products(m: np.ndarray, reduce: Reduce) -> np.ndarray:
    out = m[:, 0]
    for t in range(1, m.shape[1]):
        out = compose(out, m[:, t], reduce)
    return out


def transfer(m: np.ndarray, reduce: Reduce) -> np.ndarray:
    """The product of all matrices (n, k, k), in pairs."""
    out = _products(_blocked(m), reduce)
    while len(out) > 1:
        odd = out[-1:] if len(out) % 2 else out[:0]
        out = np.concatenate([compose(out[: len(out) - len(odd) : 2], out[1 : len(out) - len(odd) + 1 : 2], reduce), odd])
    return out[0]


def forward(start: np.ndarray, m: np.ndarray, reduce: Reduce) -> np.ndarray:
    """(n + 1, k): the vector before the first matrix and after each."""
    n, m = len(m), _blocked(m)
    ends = _products(m, reduce)
    into = [start]
    for b in range(len(m) - 1):
        into.append(onward(into[-1], ends[b], reduce))
    v = np.array(into)
    out = np.empty((len(m), m.shape[1], len(start)))
    for t in range(m.shape[1]):
        v = onward(v, m[:, t], reduce)
        out[:, t] = v
    return np.concatenate([start[None], out.reshape(-1, len(start))[:n]])


def backward(end: np.ndarray, m: np.ndarray, reduce: Reduce) -> np.ndarray:
    """(n + 1, k): the vector before each matrix, and the last one."""
    n, m = len(m), _blocked(m)
    ends = _products(m, reduce)
    into = [end]
    for b in range(len(m) - 1, 0, -1):
        into.append(back(ends[b], into[-1], reduce))
    v = np.array(into[::-1])
    out = np.empty((len(m), m.shape[1], len(end)))
    for t in range(m.shape[1] - 1, -1, -1):
        v = back(m[:, t], v, reduce)
        out[:, t] = v
    return np.concatenate([out.reshape(-1, len(end))[:n], end[None]])


def traced(maps: np.ndarray) -> np.ndarray:
    """(n + 1, k): for maps (n, k) from the state after a row to the one before it, the states before each row and last,
    for each state at the end."""
    n, k = maps.shape
    blocks, steps = _shape(max(n, 1))
    fill = np.broadcast_to(np.arange(k), (blocks * steps - n, k))
    m = np.concatenate([maps, fill]).reshape(blocks, steps, k).astype(np.int64)
    row = np.arange(blocks)[:, None]
    whole = np.broadcast_to(np.arange(k), (blocks, k))
    for t in range(steps - 1, -1, -1):
        whole = m[row, t, whole]
    into = [np.arange(k)]
    for b in range(blocks - 1, 0, -1):
        into.append(whole[b][into[-1]])
    state = np.array(into[::-1])
    out = np.empty((blocks, steps, k), np.int64)
    for t in range(steps - 1, -1, -1):
        state = m[row, t, state]
        out[:, t] = state
    return np.concatenate([out.reshape(-1, k)[:n], np.arange(k)[None]])
