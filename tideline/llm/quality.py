"""Quality rules: base rules of a text, and lines that many documents of a host share.

Native DataFrame functions only. Lines are normalised (lower case, no white space at the ends) and hashed; per
host (the source), the distinct documents that hold a line are counted. A document is known by the set of all its lines,
so copies count once and a much-copied document does not turn into boilerplate; documents that differ in a line are two.
Lines in more documents of a host than the limits allow are removed, and a document with too few words left is rejected.

The removed lines of a host are few (each is in a set share of its documents), so they are joined as one array per host
to documents that carry their measures. A long line in more documents of all hosts together than a fixed number goes
too, however large its host. Such lines grow in number with the corpus, so each document gets only its own of them.

Edge cases: a null or empty text has no words and fails the base rules; a null source is a host of its own; repeated
rows count as one document; an empty table gives an empty result; other columns are passed through whatever their names,
but for those named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line is removed where more than both of these documents of a host hold it.
    max_line_documents: int = 20
    max_line_share: float = 0.1
    #: A line of at least so many words is removed from all hosts where more documents of all hosts hold it (none: no limit).
    most_line_documents: int | None = 1000
    long_line_words: int = 5


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: The white space that parts words, and what counts as a symbol.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def without(text: Column, characters: str, put: str = "") -> Column:
    """Plain replacements: they cost a scan each and no copy where a character does not occur."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def split_words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(without(text, BLANKS[1:], " "), " "), "")


def split_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a line in lower case, without white space at its ends."""
    plain = F.btrim(F.lower(line), F.lit(BLANKS))
    return F.conv(F.substring(F.md5(plain.cast("binary")), 1, 15), 16, 10).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Places covered by windows at the rising ``starts``."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("int").alias("at"))

    def add(acc: Column, at: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(width), at - acc["at"])).cast("long").alias("n"), at.cast("int").alias("at"))

    return F.aggregate(starts, first, add, lambda acc: acc["n"])


def _repeated_exactly(words: Column, width: int) -> Column:
    """Words in windows that occur twice or more: windows sorted, equal neighbours kept, their places covered."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("w"), i.alias("at")))

    def starts(ordered: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["w"] == x["w"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, repeated), lambda x: x["at"]))

    return let(let(F.sort_array(windows), starts), lambda at: _covered(at, width))


def repeated_words(words: Column, width: int) -> Column:
    """Only texts in which some hash of a window repeats are looked at exactly. ``words`` is worked out once, wherever
    the planner puts the expression."""

    def some(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))
        return let(windows, lambda w: F.size(F.array_distinct(w)) < F.size(w))

    def counted(own: Column) -> Column:
        repeats = let(F.transform(own, lambda w: F.xxhash64(w)), some)
        return F.when(F.size(own) > width, F.when(repeats, _repeated_exactly(own, width)))

    return let(words, counted)


def document_key(hashes: Column) -> Column:
    """A document by the rising distinct hashes of all its lines."""
    return F.xxhash64(hashes)


def lined(docs: DataFrame, settings: QualitySettings) -> DataFrame:
    """``_host``, ``_doc`` and ``_all`` (hash of each distinct line, and whether it is long) of documents with a line."""
    hashed = F.transform(split_lines(F.col("text").cast("string")), lambda x: F.struct(line_hash(x).alias("h"), (F.size(split_words(x)) >= settings.long_line_words).alias("long")))
    out = docs.select(F.col("source").alias("_host"), F.array_sort(F.array_distinct(hashed)).alias("_all")).where(F.size("_all") > 0)
    return materialise(out.withColumn("_doc", document_key(F.col("_all.h"))), "lined")


def shared_lines(lines: DataFrame, settings: QualitySettings) -> DataFrame:
    """Per host with any: ``_host`` and ``_removed``, the hashes of the lines above its limits."""
    each = lines.select("_host", "_doc", F.explode("_all.h").alias("_line"))
    held = each.distinct().groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    # Only lines above the absolute limit go on.
    often = materialise(held.where(F.col("_n") > settings.max_line_documents), "often")
    sizes = lines.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("_size"))
    above = often.join(sizes, often["_host"].eqNullSafe(sizes["_host"])).where(F.col("_n") > settings.max_line_share * F.col("_size"))
    return materialise(above.groupBy(often["_host"]).agg(F.collect_set("_line").alias("_removed")), "removed_lines")


def common_lines(lines: DataFrame, settings: QualitySettings) -> DataFrame:
    """Per document with any: ``_key`` and ``_common``, the hashes of its long lines above the limit over all hosts."""
    long = lines.select("_doc", F.explode("_all").alias("_line")).where("_line.long").select("_doc", F.col("_line.h").alias("_line")).distinct()
    wide = materialise(long.groupBy("_line").agg(F.count("*").alias("_n")).where(F.col("_n") > settings.most_line_documents).select("_line"), "wide_lines")
    return materialise(long.join(wide, "_line", "left_semi").groupBy(F.col("_doc").alias("_key")).agg(F.collect_set("_line").alias("_common")), "common_lines")


def measure(frame: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """A frame with ``text`` and the measures, ``base_failed`` and ``_lines``, hash and words of each line."""
    s = settings or QualitySettings()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = frame.withColumn("_words", split_words(text)).withColumn("_worded", split_lines(text))
    return (
        out.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeated_words(F.col("_words"), s.window), F.lit(0)).cast("long"))
        .withColumn("_lines", F.transform("_worded", lambda x: F.struct(line_hash(x).alias("h"), F.size(split_words(x)).alias("n"))))
        .drop("_words", "_worded")
        .withColumn("base_failed", (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words")))
    )


def marked(measured: DataFrame, docs: DataFrame, settings: QualitySettings) -> DataFrame:
    """A measured frame of ``docs`` with ``source`` and ``_removed``, the hashes of the lines it loses (null: none)."""
    lines = lined(docs, settings)
    out = measured.join(shared_lines(lines, settings), F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    if settings.most_line_documents is None:
        return out
    key = document_key(F.array_sort(F.array_distinct(F.col("_lines.h"))))
    # One plan at every size: a table that is broadcast while small and dealt out later would not grow in proportion.
    common = common_lines(lines, settings).hint("merge")
    out = out.withColumn("_doc", key).join(common, F.col("_doc") == F.col("_key"), "left").drop("_doc", "_key")
    both = F.when(F.col("_common").isNull(), F.col("_removed")).when(F.col("_removed").isNull(), F.col("_common")).otherwise(F.concat("_removed", "_common"))
    return out.withColumn("_removed", both).drop("_common")


def judge(joined: DataFrame, settings: QualitySettings) -> DataFrame:
    """A marked frame with ``n_left`` (words outside removed lines) and ``kept``."""
    lost = F.aggregate(F.filter("_lines", lambda x: F.array_contains("_removed", x["h"])), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    left = F.when(F.col("_removed").isNull(), F.col("n_words")).otherwise(F.col("n_words") - lost)
    # One comparison: a conjunction would be split, and the measures worked out a second time to filter early.
    kept = F.when(F.col("base_failed"), F.lit(-1).cast("long")).otherwise(F.col("n_left")) >= settings.min_words
    return joined.withColumn("n_left", left).withColumn("kept", kept).drop("_lines")


VERDICT = (*MEASURES, "base_failed", "kept", "n_left")


def verdicts(docs: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """Every document with its measures and verdict, without its text."""
    s, without = settings or QualitySettings(), ("text", *VERDICT)
    measured = measure(packed(docs, {"text": "text", "source": "source"}, without), s).drop("text")
    return unpacked(judge(marked(measured, docs, s), s), docs, without, **{c: c for c in VERDICT})


def cleaned(docs: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """The kept documents, with their own columns, without the lines above the limits."""
    s = settings or QualitySettings()
    measured = measure(packed(docs, {"text": "text", "source": "source"}, ("text",)), s)
    judged = judge(marked(measured, docs, s), s).where("kept")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_removed", line_hash(x))), "\n")
    return unpacked(judged, docs, text=F.when(F.col("_removed").isNull(), F.col("text")).otherwise(rest))
