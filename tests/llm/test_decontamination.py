import re

import pytest

from tideline.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
DOCS = [
    (1, f"noise ALPHA Beta, gamma; delta\tepsilon zeta eta theta iota kappa lambda tail"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "the short one is here: École fermée"),
    (3, "the short one is here: école fermée"),
    (4, None), (5, ""), (None, LONG), (6, LONG + " " + LONG), (6, LONG + " " + LONG), (None, None),
    (7, "dup dup dup dup dup dup dup dup dup dup dup"), (8, "\x00..--"), (9, "x " * 5000 + LONG),
]
ITEMS = [(10, LONG), (11, "École FERMÉE"), (12, None), (13, ""), (14, "dup " * 10), (2, LONG), (None, "short one"), (10, LONG)]


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        iw = words(t)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[s : s + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        items.add(str(item))
    return len(w), len(hit), sorted(items)


@pytest.fixture
def frames(spark):
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in DOCS], "doc_id long, text string, term string, place int").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(frames):
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in D.contamination(*frames).collect())
    want = sorted((str(i), *brute(t), brute(t)[1] > 0) for i, t in DOCS)
    assert got == want


def test_decontaminated_keeps_clean_rows_and_columns(frames):
    out = D.decontaminated(*frames)
    assert out.columns == frames[0].columns
    assert sorted(str(r.doc_id) + str(r.text) for r in out.collect()) == sorted(str(i) + str(t) for i, t in DOCS if not brute(t)[1])


def test_empty_tables(spark, frames):
    docs, items = frames
    assert D.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.contamination(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma one delta epsilon zeta two eta theta iota kappa lambda mu nu"), (2, "alpha kappa")], "doc_id long, text string")
    index = D.build_index(docs, spark.createDataFrame([(5, LONG)], "item_id long, text string"))
    assert D.phrase_matches(index).count() == 0
    near = D.proximity_matches(index, slop=3).collect()
    assert {(r.item_id, r.doc_id) for r in near} == {(5, 1)} and max(r.n_terms for r in near) == 13
