"""Line dedup: lines that many documents hold stay in one of them.

A text is split at line feeds; a line's key is the line without white space at its ends, A-Z in lower case. Keys of a set
length are exploded as 128-bit hashes, distinct documents are counted per hash, and a key in enough documents loses all
its lines but those of the largest document id that holds it. The other lines are put together again by position.

Documents and hashes are made distinct before they are counted, so a line that a third of all documents hold is a
partial count per task. Its documents are found by a sort-merge join, whose large partitions adaptive execution splits,
and the plan is the same at every size. Hashes to remove are gathered per text, so a group is never larger than a text's
own lines.

Edge cases: a null or empty text is one empty line and comes out empty; all rows without an id are one document, smaller
than any other; rows that repeat an id are one document, and each loses its lines; a line repeated inside a document
counts once and is lost or kept as a whole; ties do not arise, as a document id is largest or it is not. Lines are
compared as bytes, so any text goes. An empty table gives an empty result. Other columns are passed through whatever
their names, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class LineSettings:
    #: Code points from which a key counts.
    min_chars: int = 40
    #: Documents from which its lines go.
    min_documents: int = 5


#: Fixed value: the white space taken off the ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
RESULTS = ("n_lines", "n_dropped")


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None for a short one."""
    key = line.strip(BLANKS).lower()  # of bytes: A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _row_key(id_column: Column) -> Column:
    """Names a text of a document; rows that repeat both share it."""
    marked = F.coalesce(F.concat(F.lit("="), id_column.cast("string")), F.lit("")).cast("binary")
    return F.unhex(F.md5(F.concat(marked, F.lit("\n").cast("binary"), F.coalesce(F.col("_text"), F.lit("").cast("binary")))))


def exploded(rows: DataFrame, settings: LineSettings) -> DataFrame:
    """(_row, _id, _line): the distinct hashes of each row's keys."""
    kind = rows.schema["_id"].dataType.simpleString()

    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at: list[int] = []
            hashes: list[bytes] = []
            for i, text in enumerate(batch.column(2)):
                own = {h for h in (line_hash(x, settings.min_chars) for x in _lines(text.as_py())) if h}
                hashes += sorted(own)
                at += [i] * len(own)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(hashes, pa.binary())], names=["_row", "_id", "_line"])

    return rows.select("_row", "_id", "_text").mapInArrow(explode, f"_row binary, _id {kind}, _line binary")


def common_lines(lines: DataFrame, settings: LineSettings) -> DataFrame:
    """(_often, _keeper): hashes in enough documents, and the largest id that holds them."""
    counted = lines.select("_line", "_id").distinct().groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keeper"))
    return counted.where(F.col("_n") >= settings.min_documents).select(F.col("_line").alias("_often"), "_keeper")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", settings: LineSettings | None = None) -> DataFrame:
    """Every row with the lines it keeps as ``text``, ``n_lines`` before and ``n_dropped``."""
    s = settings or LineSettings()
    own = (*RESULTS, "text")
    rows = packed(docs, {"_id": F.col(f"`{id_column}`"), "_text": F.col("text").cast("string").cast("binary")}, own)
    rows = rows.withColumn("_row", _row_key(F.col("_id")))
    lines = exploded(rows, s)
    common = materialise(common_lines(lines, s), "common_lines").hint("merge")
    lost = lines.join(common, F.col("_line") == F.col("_often")).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    lost = lost.groupBy(F.col("_row").alias("_of")).agg(F.collect_set("_line").alias("_lost")).hint("merge")
    joined = rows.join(lost, F.col("_row") == F.col("_of"), "left").select("whole", "_text", "_lost")

    def reassemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts: list[bytes] = []
            counts: list[tuple[int, int]] = []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                parts = _lines(text.as_py())
                gone = set(lost.as_py() or ())
                kept = [x for x in parts if line_hash(x, s.min_chars) not in gone] if gone else parts
                texts.append(b"\n".join(kept))
                counts.append((len(parts), len(parts) - len(kept)))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *numbers], names=["whole", "text", *RESULTS])

    schema = f"whole {rows.schema['whole'].dataType.simpleString()}, text binary, n_lines long, n_dropped long"
    found = joined.mapInArrow(reassemble, schema)
    return unpacked(found, docs, RESULTS, text=F.col("text").cast("string"), **{c: c for c in RESULTS})
