import duckdb
import pytest
from compare import differences

from tideline.llm import quality as Q
from tideline.llm.queries import SQL
from tideline.llm.registry import QUERIES

TEXTS = [None, "", " \n\t ", "one two three four five six seven eight nine ten", "a b c d e " * 4, "x", "l1\nl1\n l1\nl2\r\nl2\r\n\n\n", "# $ % & | < > *** é ü 漢字 words here and more to get to ten of them",
         "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z " * 1, "same " * 3000, "\x0b\x0cA\u00a0b"]


def rows():
    out = [(i, t, "s0") for i, t in enumerate(TEXTS)] + [(i, t, "s0") for i, t in enumerate(TEXTS)] + [(None, "null id text", None)]
    for i in range(60):  # a line that a host repeats, and documents of little else
        out.append((100 + i, f" Click here to SUBSCRIBE now to our letter \t\nThis is text {i} and its {i * 7} words are only its own, all of them.", "s1"))
        out.append((200 + i, f"click here to subscribe now to our letter\nw{i} x{i}", "s1"))
    out += [(300 + i, f"copied line one of this document here\ncopied line two of it is here", "s2") for i in range(60)]
    out += [(400 + i, f"near copied line one of this document\nline {i % 3} of it is here too\nline three of the document", "s3") for i in range(60)]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    note = differences(QUERIES["op8_quality"](spark, folder).toPandas(), con.execute(SQL["op8_quality"]).df())
    assert not note, note


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_against_brute_force(spark, folder):
    got = QUERIES["op8_quality"](spark, folder).collect()
    want = sorted((str(i), *brute(t)) for i, t, _ in rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_shared_lines_and_copies(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("kept", __import__("pyspark").sql.functions.lit("x"))
    got = {r.doc_id: r for r in Q.verdicts(docs).collect()}
    assert all(got[100 + i].kept and got[100 + i].n_left < got[100 + i].n_words for i in range(60))
    assert not any(got[200 + i].kept or got[200 + i].base_failed for i in range(60) if got[200 + i].n_words >= 10)
    assert all(got[300 + i].kept and got[400 + i].kept for i in range(60))  # copies are not boilerplate
    clean = Q.cleaned(docs.drop("kept")).collect()
    assert all("ubscribe" not in r.text.lower() for r in clean if r.source == "s1") and clean[0].__fields__ == ["doc_id", "text", "source"]
    assert Q.verdicts(docs.limit(0)).count() == 0


def left_by(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r.doc_id: r.text for r in Q.cleaned(docs, Q.QualitySettings(**limits)).collect()}


def own(i):
    return " ".join(f"own{i}word{k}" for k in range(12))


def test_documents_of_many_shared_lines_count_each(spark):
    """200 different documents of 20 shared lines and one of their own, and a copied document that stays."""
    shared = "\n".join(f"shared{k} line{k} of{k} the{k} frame{k}" for k in range(20))
    rows = [(i, f"{shared}\n{own(i)}", "h") for i in range(200)] + [(1000 + i, f"{own(-1)}\n{own(-2)}", "h") for i in range(60)]
    assert left_by(spark, rows, most_line_documents=None) == {i: own(i) if i < 200 else t for i, t, _ in rows}


def test_a_common_line_goes_whatever_the_size_of_its_host(spark):
    line, short = "all rights reserved by the owners of this site", "read more"
    rows = [(i, f"{own(i)}\n{line if i % 8 == 0 else own(i + 5000)}\n{short if i % 8 == 0 else own(i + 9000)}", f"h{i % 3 % 2}") for i in range(480)]
    rows += [(1000 + i, f"{own(-1)}\n{own(-2)}", f"h{i % 2}") for i in range(100)]  # copies over hosts
    want = {i: "\n".join(x for x in t.split("\n") if x != line) for i, t, _ in rows}
    assert left_by(spark, rows, max_line_share=0.5, most_line_documents=50) == want
    assert left_by(spark, rows, max_line_share=0.5, most_line_documents=60) == {i: t for i, t, _ in rows}  # 60 hold it


def test_query_counts_distinct_documents(spark, tmp_path):
    """Documents that share many lines each count, copies once, and a long line goes that many hosts hold a little."""
    shared = "\n".join(f"shared{k} line{k} of{k} the{k} frame{k}" for k in range(20))
    line = "all rights reserved by the owners of this site"
    rows = [(i, f"{shared}\n{own(i)}", "h") for i in range(200)] + [(1000 + i, f"{own(-1)}\n{own(-2)}", "h") for i in range(60)]
    rows += [(300 + i, f"{shared}\nlittle else {i}", "h") for i in range(5)] + [(2000 + i, f"{own(i)}\n{line}", f"h{i % 60}") for i in range(1020)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.base_failed, r.kept, r.n_left) for r in QUERIES["op8_quality"](spark, str(tmp_path)).collect()}
    want = {i: (False, True, 24 if 1000 <= i < 2000 else 12) for i, _, _ in rows}
    assert got == want | {300 + i: (False, False, 3) for i in range(5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_lines_against_brute_force(spark, seed):
    rng = __import__("random").Random(seed)
    pool = [f"line {k} of a pool with {'more ' * (k % 4)}words" for k in range(30)]
    rows = [(i, "\n".join([own(i % 90), *(x for x in pool if rng.random() < rng.choice((0.05, 0.4)))]), rng.choice(["a", "a", "b", None])) for i in range(150)]
    key = {i: frozenset(t.split("\n")) for i, t, _ in rows}
    gone = {}
    for host in ("a", "b", None):
        mine = {key[i] for i, _, s in rows if s == host}
        gone[host] = {x for x in pool if (n := sum(x in d for d in mine)) > 5 and n > 0.25 * len(mine)}
    wide = {x for x in pool if len(x.split()) >= 8 and sum(x in d for d in set(key.values())) > 30}
    want = {i: "\n".join(x for x in t.split("\n") if x not in gone[s] | wide) for i, t, s in rows}
    assert wide and any(gone.values()) and left_by(spark, rows, max_line_documents=5, max_line_share=0.25, most_line_documents=30, long_line_words=8, max_repeat_percent=100) == want
