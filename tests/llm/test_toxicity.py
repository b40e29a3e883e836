import zlib

import numpy as np

from tideline.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_held_out_accuracy(spark):
    from tideline.llm.queries import QUERIES

    got = QUERIES["op5_toxicity"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [fold(i) == 0 for i in got.index]).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    test = got[got["held_out"]].join(labels, how="inner")
    rank = test["score"].rank()
    n1, n0 = (test["toxic"] == 1).sum(), (test["toxic"] == 0).sum()
    assert (rank[test["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert test.loc[test["predicted"] == 1, "toxic"].mean() > 0.85


def test_feature_ids_see_the_whole_text():
    base = T.feature_ids("abcdef", (3,), 18)
    assert len(base) == 4 and len(T.feature_ids(None, (3, 4), 18)) == 0 and len(T.feature_ids("ab", (3,), 18)) == 0
    long = "x " * 50000 + "zqzq"
    assert np.isin(T.feature_ids("zqzq", (4,), 18), T.feature_ids(long, (4,), 18)).all()
    assert (T.feature_ids("ABC", (3,), 18) == T.feature_ids("abc", (3,), 18)).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in [(1, "you vile fool"), (2, "a kind word"), (3, None), (4, ""), (None, "vile"), (1, "you vile fool")]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    out = T.score(docs, model)
    got = [(r.doc_id, r.text, r.score) for r in out.collect()]
    by = {t: s for _, t, s in got}
    assert out.columns == docs.columns and len(got) == 6 and by["you vile fool"] > by["a kind word"] and by[None] == by[""]
    assert by["vile"] > 0.5
    alone = T.fit(docs, labels.where("toxic = 1"))
    assert len({r.score for r in T.score(docs, alone).collect()}) == 1
    none = T.fit(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.5} and T.score(docs.limit(0), none).count() == 0
