"""Benchmark decontamination by a positional inverted index.

Native DataFrame functions only. One pass over the training texts stores the postings (term, document, place) of every
term that the benchmark uses. For each window of benchmark words the rarest terms, by postings, are looked up first:
their lists, shifted by the terms' offsets in the item, are intersected on (item, document, shift), which leaves few
alignments. Along these the lists of all other terms are intersected in the same way, and a run of matching places as
long as a window is an exact phrase match; ``proximity_matches`` lets each term be off by some words instead.

Postings, items and alignments are written tables, so their sizes are known to the planner and lost executors cost
little; what is small enough is broadcast by the planner's own check, the rest is joined by keys that hold a place or a
shift besides the document, so no document or passage makes a large group.

Edge cases: null and empty texts have no words and no hits; items without words have no window; items that share an
item_id count once, a null item_id gives hits but no item; rows that are repeated, or share a doc_id, are kept apart by
a hash of their text and get a row each; empty tables give no hits. Only the id and the text are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked
from tideline.session import materialise

#: Fixed value: what parts words, anything but ASCII digits, ASCII letters (in lower case by then) and characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A term that no text holds; its posting says how many words a document has.
END = " "


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


@dataclass(frozen=True)
class Index:
    """Written tables: postings (term, doc_id, text, place), items (item, item_id, n, at, term), sizes (term, n)."""

    postings: DataFrame
    items: DataFrame
    frequencies: DataFrame

    def lengths(self) -> DataFrame:
        """A row per document row: doc_id, text, n_words."""
        return self.postings.where("term = -1").select("doc_id", "text", F.col("place").cast("long").alias("n_words"))


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """``docs``: doc_id, text; ``benchmark``: item_id, text."""
    numbered = materialise(benchmark.select("item_id", words_of(F.col("text")).alias("words")).distinct().where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    placed = numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    terms = placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    end = docs.sparkSession.createDataFrame([(END, -1)], "word string, term long")
    terms = materialise(terms.unionByName(end), "terms")
    items = materialise(placed.join(terms, "word").drop("word"), "item_words")
    text = F.col("text").cast("string")
    words = docs.select("doc_id", F.xxhash64(text).alias("text"), F.concat(words_of(text), F.array(F.lit(END))).alias("words"))
    tokens = words.select("doc_id", "text", F.posexplode("words").alias("place", "word"))
    postings = materialise(tokens.join(terms, "word").select("term", "doc_id", "text", "place"), "postings")
    frequencies = materialise(postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    return Index(postings, items, frequencies)


def _windows(index: Index, width: int) -> DataFrame:
    """item, window, at, term, rank of every place in every window all of whose terms have postings; rank by rarity."""
    rare = index.items.join(index.frequencies.withColumnRenamed("n", "postings"), "term", "left").fillna(0, ["postings"])
    last = F.greatest(F.col("n") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("at") - width + 1, F.lit(0)), F.least(F.col("at"), last))
    within = rare.where(F.col("at") - width + 1 <= last).select("item", F.explode(starts).alias("window"), "at", "term", "postings")
    window = W.partitionBy("item", "window")
    ranked = within.withColumn("rank", F.row_number().over(window.orderBy("postings", "at"))).withColumn("least", F.min("postings").over(window))
    return ranked.where("least > 0")


def _alignments(index: Index, width: int) -> DataFrame:
    """(item, doc_id, text, shift) where the two rarest terms of some window stand at the right distance."""
    windows = _windows(index, width)
    seeds = materialise(windows.where("rank <= 2").groupBy("item", "window").agg(F.min_by("at", "rank").alias("at1"), F.max_by("at", "rank").alias("at2"), F.min_by("term", "rank").alias("term1"), F.max_by("term", "rank").alias("term2")).select("item", "at1", "term1", "at2", "term2").distinct(), "seeds")
    first = index.postings.join(seeds.select("item", "at1", "term1", "at2", "term2"), F.col("term") == F.col("term1"))
    first = first.select("item", "doc_id", "text", (F.col("place") - F.col("at1")).alias("shift"), "at2", "term2").distinct()
    # A window of one term is found by it alone; the others by the second term at its place.
    first = materialise(first, "first_lists")
    probe = first.select("item", "doc_id", "text", "shift", F.col("term2").alias("term"), (F.col("shift") + F.col("at2")).alias("place"))
    both = _at_places(probe, index.postings.join(seeds.select(F.col("term2").alias("term")).distinct(), "term", "left_semi"))
    return materialise(both.select("item", "doc_id", "text", "shift").distinct(), "alignments")


def _at_places(probe: DataFrame, postings: DataFrame) -> DataFrame:
    """The rows of ``probe`` whose term stands at their place of their document."""
    p = postings.select(F.col("term").alias("_term"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.col("place").alias("_place"))
    on = (F.col("place") == F.col("_place")) & (F.col("term") == F.col("_term")) & (F.col("text") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return probe.join(p, on, "left_semi")


def phrase_matches(index: Index, width: int = 10) -> DataFrame:
    """Exact matches: item_id, doc_id, text, place (of a document word inside an occurrence of a window)."""
    found = _alignments(index, width)
    holders = materialise(found.select("doc_id", "text").distinct(), "holders")
    h = holders.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    near = index.postings.join(h, (F.col("text") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    words = index.items.select("item", "item_id", "n", "at", "term")
    probe = found.join(words, "item").select("item", "item_id", "n", "doc_id", "text", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("place"))
    matched = _at_places(probe, near)
    run = W.partitionBy("item", "doc_id", "text", "shift").orderBy("at")
    runs = matched.withColumn("run", F.col("at") - F.row_number().over(run))
    runs = runs.withColumn("length", F.count("*").over(W.partitionBy("item", "doc_id", "text", "shift", "run")))
    return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(width))).select("item_id", "doc_id", "text", "place")


def proximity_matches(index: Index, width: int = 10, slop: int = 3, share: float = 0.8) -> DataFrame:
    """Looser matches: item, item_id, doc_id, text, shift, n_terms. Along an alignment, at least ``share`` of the item's
    words stand within ``slop`` words of their places."""
    found = _alignments(index, width)
    words = index.items.select("item", "item_id", "n", "at", "term")
    offs = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off")
    probe = found.join(words, "item").select("*", offs).withColumn("place", F.col("shift") + F.col("at") + F.col("off"))
    terms = _at_places(probe, index.postings).groupBy("item", "item_id", "n", "doc_id", "text", "shift").agg(F.count_distinct("at").alias("n_terms"))
    return terms.where(F.col("n_terms") >= share * F.col("n")).drop("n")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """A row per row of ``docs``: doc_id, text (its hash), n_words, n_hit, item_ids (sorted strings), contaminated."""
    index = build_index(docs, benchmark)
    matches = phrase_matches(index, width)
    hits = matches.groupBy("doc_id", "text").agg(F.count_distinct("place").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"), "n_hit", "item_ids")
    joined = index.lengths().join(hits, (F.col("text") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d", "_t")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    index = build_index(docs, benchmark)
    bad = materialise(phrase_matches(index, width).select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).distinct(), "contaminated")
    frame = packed(docs, {"_doc": "doc_id", "_text": F.xxhash64(F.col("text").cast("string"))})
    return unpacked(frame.join(bad, (F.col("_text") == F.col("_t")) & F.col("_doc").eqNullSafe(F.col("_d")), "left_anti"), docs)
