"""Token files in training order.

Documents become token ids, and each partition's stream is cut into sequences of a set length (the last one padded).
Sequences are numbered in a range reserved per partition: text bytes plus documents bound its tokens, so the numbering
needs no second tokenisation. A keyed Feistel network with cycle-walking permutes the reserved numbers, equal ranges of
the permuted numbers are shards, and a sequence's global slot is its rank in the permuted order: the counts of the
shards before, plus its place in its own. Shards are binary files of fixed-stride records, so slot k is found by one
lookup in the small manifest and one seek, and a reader can stop and resume at any slot.

A shard is written under a name of its own by each attempt and then moved into place, so a task that is run again after
a lost executor only replaces a file with the same bytes.

Edge cases: a null or empty text is one end-of-document id; repeated rows are kept; an empty table gives no shard and an
empty manifest; other columns are ignored; null ids are carried.
"""

from __future__ import annotations

import bisect
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.tokens import crc32, document_ids, vocabulary_path
from tideline.session import materialise

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. size-1."""

    size: int
    key: int
    rounds: int = 6

    def _half(self) -> np.uint64:
        return np.uint64(max(1, -(-max(self.size - 1, 1).bit_length() // 2)))

    def _once(self, x: np.ndarray, rounds: range) -> np.ndarray:
        half = self._half()
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for r in rounds:
            salt = np.uint64((self.key * 0x9E3779B97F4A7C15 + r + 1) & int(_MASK))
            left, right = right, left ^ (_mix(right + salt) & mask)
        return (right << half) | left  # halves swapped, so that the inverse is the same walk with rounds reversed

    def _walk(self, numbers: np.ndarray, rounds: range) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(numbers).astype(np.uint64), rounds)
            while (outside := out >= np.uint64(self.size)).any():
                out[outside] = self._once(out[outside], rounds)
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, range(self.rounds))

    def inverse(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, range(self.rounds)[::-1])


@dataclass(frozen=True)
class FileSettings:
    length: int = 2048
    key: int = 20240229
    pad: int = 65535  # no id of the vocabulary
    dtype: str = "<u2"
    #: Shards hold at least ``least`` and at most ``most`` records, and are ``shards`` in number between the two.
    shards: int = 256
    least: int = 64
    most: int = 65536


def shard_count(expected: int, s: FileSettings) -> int:
    return max(1, -(-expected // min(max(expected // s.shards, s.least), s.most)))


_PIECE = "struct<doc_id: bigint, start: bigint, length: bigint, ids_crc32: bigint>"
_RECORDS = f"number long, ids binary, pieces array<{_PIECE}>"
_WRITTEN = f"shard int, place long, pieces array<{_PIECE}>"


def _records(docs: DataFrame, s: FileSettings, vocabulary: str, first: dict[int, int], room: dict[int, int]) -> DataFrame:
    """Sequences with their reserved numbers."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("number", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32")])))])
        part = TaskContext.get().partitionId()
        made, held, pieces, rows = 0, [], [], []
        free = s.length

        def close():
            nonlocal made, held, pieces, free
            if made >= room.get(part, 0):
                raise RuntimeError("the input's partitions changed between two scans")
            ids = np.full(s.length, s.pad, dtype=s.dtype)
            ids[: s.length - free] = np.concatenate(held)
            rows.append({"number": first[part] + made, "ids": ids.tobytes(), "pieces": pieces})
            made, held, pieces, free = made + 1, [], [], s.length

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, start = document_ids(text.as_py(), vocabulary), 0
                while start < len(ids):
                    piece = ids[start : start + free]
                    held.append(piece)
                    pieces.append({"doc_id": doc_id, "start": start, "length": len(piece), "ids_crc32": crc32(piece)})
                    start, free = start + len(piece), free - len(piece)
                    if not free:
                        close()
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if held:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(cut, _RECORDS)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write(docs: DataFrame, path: str, settings: FileSettings | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write shards and a manifest below ``path`` (a folder that all executors see) and return the pieces:
    doc_id, start, length, ids_crc32, slot, shard, place, offset (in tokens, within the record)."""
    s, vocabulary = settings or FileSettings(), vocabulary or vocabulary_path()
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    first, room, size = {}, {}, 0
    for part, tokens in sorted(tuple(r) for r in chosen.groupBy(F.spark_partition_id()).agg(bound).collect()):
        first[part], room[part] = size, -(-tokens // s.length)
        size += room[part]
    shards, order = shard_count(size, s), Feistel(max(size, 1), s.key)

    def permuted(numbers):
        import pyarrow as pa

        return pa.array(order.forward(numbers.to_numpy()))

    numbered = _records(chosen, s, vocabulary, first, room).withColumn("_slot", F.arrow_udf(permuted, "long")("number"))
    dealt = numbered.withColumn("shard", F.expr(f"cast(_slot * {shards}L div {max(size, 1)}L as int)"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "_slot").select("shard", "ids", "pieces")

    def write_shards(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(path))
        store.create_dir(root, recursive=True)
        out, shard, place, temporary = None, None, 0, ""

        def close():
            out.close()
            store.move(temporary, posixpath.join(root, shard_name(shard)))

        for batch in batches:
            places = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != shard:
                    if out:
                        close()
                    shard, place = k, 0
                    temporary = posixpath.join(root, f".{shard_name(k)}-{uuid.uuid4().hex}")
                    out = store.open_output_stream(temporary)
                out.write(ids.as_py())
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(2)], names=["shard", "place", "pieces"])
        if out:
            close()

    written = materialise(dealt.mapInArrow(write_shards, _WRITTEN), "token_pieces")
    counts = sorted(tuple(r) for r in written.groupBy("shard").agg(F.max("place") + 1).collect())  # a row per shard
    before, total = [], 0
    for shard, n in counts:
        before.append((shard, total, n))
        total += n
    manifest = spark.createDataFrame(before, "shard int, first_slot long, records long")
    manifest.withColumn("length", F.lit(s.length)).withColumn("dtype", F.lit(s.dtype)).coalesce(1).write.parquet(f"{path}/manifest")
    pieces = written.select("shard", "place", F.posexplode("pieces").alias("_k", "piece"), "pieces")
    offset = F.aggregate(F.slice("pieces", 1, F.col("_k")), F.lit(0).cast("long"), lambda acc, p: acc + p["length"])
    placed = pieces.select("piece.*", "shard", "place", offset.alias("offset")).join(manifest.select("shard", "first_slot"), "shard")
    return placed.select("doc_id", "start", "length", "ids_crc32", (F.col("first_slot") + F.col("place")).alias("slot"), "shard", "place", "offset")


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class Reader:
    """Sequential reads of written shards from any slot."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()  # a row per shard
        self.path = path
        self.starts = [r["first_slot"] for r in rows]
        self.shards = [r["shard"] for r in rows]
        self.total = rows[-1]["first_slot"] + rows[-1]["records"] if rows else 0
        self.length, self.dtype = (rows[0]["length"], rows[0]["dtype"]) if rows else (0, "<u2")

    def read(self, slot: int = 0) -> Iterator[np.ndarray]:
        """Records from ``slot`` on, in training order."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        stride = self.length * np.dtype(self.dtype).itemsize
        while slot < self.total:
            k = bisect.bisect_right(self.starts, slot) - 1
            with store.open_input_file(posixpath.join(root, shard_name(self.shards[k]))) as file:
                file.seek((slot - self.starts[k]) * stride)
                while block := file.read(stride):
                    yield np.frombuffer(block, dtype=self.dtype)
                    slot += 1
