import random
import re
from collections import defaultdict

from compare import connection, differences

from tideline.llm import line_dedup as L
from tideline.llm.queries import QUERIES, SQL

SMALL = L.LineSettings(min_chars=6, min_documents=3)


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, s):
    """(id, text, n_lines, n_dropped) of (id, text)."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < s.min_chars or len(holders[key(x)]) < s.min_documents or max(holders[key(x)], key=lambda d: (d is not None, d or 0)) == doc
        ]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"line number {i}" for i in range(12)] + ["short", "éééééé", "ééééé", "ÉÉÉÉÉÉ", "", "   ", "\x0b\ttabbed line\x0c"]
    rows = []
    for i in range(200):
        lines = [rnd.choice(pool) if rnd.random() < 0.4 else f"own line {i} {k}" for k in range(rnd.randint(0, 9))]
        lines = [x.upper() + " \t" if rnd.random() < 0.3 else x for x in lines]
        rows.append((rnd.choice([None, i, i // 2]), "\n".join(lines) if rnd.random() < 0.95 else None))
    rows += rows[:40] + [(500 + i, "line number 3\nthe line of a third of all\r") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(L.deduplicated(df, settings=SMALL)) == brute(rows, SMALL)


def test_the_largest_id_keeps_its_repeats(spark):
    rows = [(i, "same line\nown\nSAME LINE ") for i in range(4)] + [(None, "same line")]
    got = result(L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), settings=SMALL))
    assert got == brute(rows, SMALL) and (3, "same line\nown\nSAME LINE ", 3, 0) in got and (None, "", 1, 1) in got


def test_long_text_clashing_columns_and_empty_table(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(100_000))
    rows = [(i, long, "old", 7) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lost string, n_lines int")
    out = L.deduplicated(df, settings=SMALL)
    assert out.columns == ["doc_id", "text", "_lost", "n_lines", "n_dropped"]
    got = {r.doc_id: (len(r.text), r.n_lines, r.n_dropped, r._2 if hasattr(r, "_2") else r["_lost"]) for r in out.collect()}
    assert got == {0: (0, 100_000, 100_000, "old"), 1: (0, 100_000, 100_000, "old"), 2: (len(long), 100_000, 0, "old")}
    assert L.deduplicated(df.limit(0), settings=SMALL).count() == 0


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = QUERIES["op13_line_dedup"](spark, sf).toPandas()
        assert (got.n_dropped > 0).any()
        note = differences(got, connection(sf).execute(SQL["op13_line_dedup"]).df())
        assert not note, note
