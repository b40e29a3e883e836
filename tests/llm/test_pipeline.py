import os
import subprocess
import sys

from test_decontamination import words
from test_packing import check
from test_simhash import groups, plain_fingerprint

import corpus_pipeline as C
from tideline.llm import quality, secrets

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    verdict = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    one = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and set(one) == {i for i, r in verdict.items() if r.kept}

    two = {r.doc_id: r.text for r in stages["near_duplicates"](spark, kept, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in one.items()}
    root = groups(prints.values())
    least = {}
    for i in sorted(one):
        least.setdefault(root[prints[i]], i)
    assert set(two) == set(least.values()) and all(two[i] == one[i] for i in two)

    frame = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in two.items()], "doc_id long, text string, lang string, source string, n_chars long")
    third = stages["decontamination"](spark, frame, SF)
    three = {r.doc_id: r.text for r in third.collect()}
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(g) for g in grams}
    clean = lambda t: not any(tuple(words(t)[i : i + n]) in grams for n in sizes for i in range(len(words(t)) - n + 1))
    assert set(three) == {i for i, t in two.items() if clean(t)} and len(three) < len(two)

    fourth = stages["secrets"](spark, third, SF)
    four = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and set(four) == set(three)
    assert all(r.text == secrets.redact_text(three[i]) and r.n_chars == len(r.text) for i, r in four.items())
    check(stages["packing"](spark, fourth, SF).toPandas(), [(i, r.text) for i, r in four.items()])


def test_run_equals_its_stages(spark):
    out = C.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tideline.session import materialise

    for _, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF))
    again = docs.toPandas()
    assert out["length"].sum() == again["length"].sum() and set(out["doc_id"]) == set(again["doc_id"])


def test_odd_tables_pass_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, _words string"
    rows = [(None, None, None, None, None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, "word " * 50, None, None, None, None, None), (2, "word " * 50, None, None, None, None, None),
            (3, "A proper text with more than ten words, and a password = hunter2hunter2 in it.", "en", "s", 1, "x", "y")]
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert {r.doc_id for r in docs.collect()} == ({3} if data else set())


def test_library_stands_alone():
    """Nothing outside this subpackage imports it."""
    code = "import sys; sys.modules['tideline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 190 and not [q for q in e.queries() if q.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
