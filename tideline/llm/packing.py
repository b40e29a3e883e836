"""Order-preserving packing of documents into token sequences of a set length.

The tokens of a partition form one stream in document order. Cuts may fall after a document (free), after a sentence
(small penalty) or anywhere (large penalty); a dynamic programme chooses the cuts that minimise padding plus penalties.
With c(j) the least cost of a stream cut at j,

    c(j) = penalty(j) + capacity - j + min over i in [j - capacity, j) of (c(i) + i)

and the minimum over the sliding range comes from a monotone queue, so the work is linear in the number of boundaries.
The stream is solved in chunks: all windows of a chunk but the last are final, and the last one opens the next chunk,
so memory is bounded by the chunk and one document. No token is dropped, and every token lies in exactly one piece.

Edge cases: a null or empty text is one end-of-document token; repeated rows are packed as they come; an empty table
gives an empty result; other columns are ignored. The order is that of the rows in their partitions (the file order
of a scan); sort or range-partition first where another order is wanted. Only the last window of a partition is short
for want of tokens.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tokens import crc32, document_ids, sentence_end_flags, vocabulary_path
from tideline.session import materialise


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 2048
    #: Cost of a cut inside a document, in tokens of padding.
    sentence_penalty: float = 4.0
    hard_penalty: float = 32.0
    #: Windows solved at a time.
    chunk_windows: int = 512


def choose_cuts(total: int, ends: np.ndarray, costs: np.ndarray, capacity: int, hard: float) -> list[int]:
    """Cut positions (the last is ``total``) of least padding plus penalties.

    ``ends``: rising candidate positions in (0, total], the last being ``total``; ``costs``: their penalties. A hard cut
    is offered where a full window after a candidate would end, if padding back to the nearest candidate costs more.
    Where two candidates lie further apart than ``capacity``, hard cuts are offered at every ``capacity`` tokens after
    the first and before the second.
    """
    full = ends[ends + capacity < total] + capacity
    full = full[full - ends[np.searchsorted(ends, full, side="right") - 1] > hard]
    ends, costs = np.concatenate((ends, full)), np.concatenate((costs, np.full(len(full), hard)))
    order = np.argsort(ends, kind="stable")
    ends, costs = ends[order], costs[order]
    gaps = np.diff(np.concatenate(([0], ends)))
    if (gaps > capacity).any():
        extra = []
        for k in np.flatnonzero(gaps > capacity):
            right = int(ends[k])
            left = right - int(gaps[k])
            extra += [*range(left + capacity, right, capacity), *range(right - capacity, left, -capacity)]
        extra = np.setdiff1d(np.array(extra, dtype=ends.dtype), ends)
        ends, costs = np.concatenate((ends, extra)), np.concatenate((costs, np.full(len(extra), hard)))
        order = np.argsort(ends, kind="stable")
        ends, costs = ends[order], costs[order]
    points, penalties = [0, *ends.tolist()], [0.0, *costs.tolist()]
    came_from = [0] * len(points)
    queue: deque = deque([(0.0, 0, 0)])  # (cost + position, position, index), rising in the first
    for j in range(1, len(points)):
        at = points[j]
        while queue[0][1] < at - capacity:
            queue.popleft()
        best, _, came_from[j] = queue[0]
        value = best + capacity + penalties[j]  # the cost up to here, plus the position
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    cuts, j = [], len(points) - 1
    while j:
        cuts.append(points[j])
        j = came_from[j]
    return cuts[::-1]


class _Packer:
    """Turns a stream of documents into pieces; keeps one chunk of tokens."""

    def __init__(self, settings: PackSettings, path: str):
        self.settings, self.path = settings, path
        self.flags = sentence_end_flags(path)
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids not yet packed, tokens before them
        self.lengths: list[int] = []  # whole documents' tokens
        self.held = 0
        self.sequence = 0

    def add(self, doc_id: int | None, text: str | None) -> list[tuple]:
        ids = document_ids(text, self.path)
        self.docs.append((doc_id, ids, 0))
        self.lengths.append(len(ids))
        self.held += len(ids)
        return self._solve(False) if self.held >= self.settings.chunk_windows * self.settings.capacity else []

    def finish(self) -> list[tuple]:
        return self._solve(True) if self.held else []

    def _solve(self, last: bool) -> list[tuple]:
        s = self.settings
        stream = np.concatenate([ids for _, ids, _ in self.docs])
        doc_ends = np.cumsum([len(ids) for _, ids, _ in self.docs])
        cost = np.where(self.flags[stream], s.sentence_penalty, np.inf)
        cost[doc_ends - 1] = 0.0
        at = np.flatnonzero(cost < np.inf)
        cuts = choose_cuts(len(stream), at + 1, cost[at], s.capacity, s.hard_penalty)
        if not last:
            cuts = cuts[:-1]  # the rest opens the next chunk
        pieces, k, used = [], 0, 0  # document and how much of it is packed
        begin = 0
        for end in cuts:
            offset = 0
            while begin < end:
                doc_id, ids, before = self.docs[k]
                n = min(len(ids) - used, end - begin)
                pieces.append((doc_id, before + used, n, crc32(ids[used : used + n]), self.lengths[k], self.sequence, offset))
                offset, begin, used = offset + n, begin + n, used + n
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        self.docs, self.lengths = self.docs[k:], self.lengths[k:]
        if used:
            doc_id, ids, before = self.docs[0]
            self.docs[0] = (doc_id, ids[used:].copy(), before + used)
        self.held -= begin
        return pieces


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long, offset long"
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def pack(docs: DataFrame, settings: PackSettings | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    ``docs`` needs doc_id and text. Sequences are numbered without gaps in partition order.
    """
    settings, path = settings or PackSettings(), vocabulary or vocabulary_path()

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        packer, part = _Packer(settings, path), TaskContext.get().partitionId()

        def table(rows: list[tuple]):
            doc, start, length, crc, tokens, sequence, offset = zip(*rows, strict=True)
            columns = [doc, start, length, crc, tokens, [part] * len(rows), sequence, offset]
            kinds = [pa.int32() if c == "part" else pa.int64() for c in _COLUMNS]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if rows := packer.add(doc_id, text.as_py()):
                    yield table(rows)
        if rows := packer.finish():
            yield table(rows)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(chosen.mapInArrow(pieces, _PIECES), "pieces")
    # One row per partition of the input: the sequences of the partitions before it.
    counts = sorted(tuple(r) for r in found.groupBy("part").agg(F.max("local") + 1).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    shift = docs.sparkSession.createDataFrame(before, "part int, before long")
    return found.join(shift, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("sequence_id"), "offset")
