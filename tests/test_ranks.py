"""Exact quantiles, ranks and salted joins on hot, tied groups."""

import numpy as np
import pandas as pd
from conftest import same

from pyspark.sql import functions as F

from tideline.functions.ranks import average_ranks, exact_quantiles
from tideline.functions.skew import join_stats
from tideline.operators.align import range_join
from tideline.operators.metrics import rank_ic, rank_ic_large, roc_auc


def hot(spark, n=6000):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "k": np.where(np.arange(n) < n * 2 // 3, "hot", np.where(np.arange(n) % 2, "x", "y")),
        "v": np.where(rng.random(n) < 0.33, 1.25, np.round(rng.normal(size=n), 3)),
    })
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def test_quantiles_match_numpy(spark):
    pdf, df = hot(spark)
    probs = {"a": 0.0, "b": 0.25, "c": 0.33, "d": 0.5, "e": 0.67, "f": 1.0}
    got = exact_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v = g.v.dropna()
        assert got.loc[k, "n"] == len(v)
        same([got.loc[k, c] for c in probs], [np.quantile(v, p) for p in probs.values()], 1e-12)
    alone = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert abs(alone["m"] - pdf.v.median()) < 1e-12


def test_quantiles_of_spread_and_tied_values(spark):
    """Heavy tails, few rows, ties at the wanted ranks, infinities; and more rows than the sketch holds."""
    rng = np.random.default_rng(2)
    groups = {
        "tails": np.exp(rng.normal(0, 30, 60_000)) * rng.choice([-1, 1], 60_000), "narrow": 100 + rng.random(40_000) * 1e-9, "ties": np.repeat([1.0, 2.0, 3.0], [10_000, 10_001, 9_999]),
        "one": np.array([4.0]), "two": np.array([4.0, 5.0]), "six": np.arange(6.0), "long": np.arange(99.0), "inf": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf).repartition(7)
    probs = {f"p{i}": i / 10 for i in range(11)} | {"q1": 0.25, "q67": 0.67, "high": 0.9999}
    got = exact_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, v in groups.items():
        assert got.loc[k, "n"] == len(v)
        for name, p in probs.items():
            if k == "inf" and name not in ("p5", "q1"):
                continue  # between an infinity and a number there is none
            want = np.quantile(v, p)
            assert abs(got.loc[k, name] - want) <= 1e-12 * max(1.0, abs(want)), (k, name)


def exchanges(df):
    """Shuffles of the plan that ran, without broadcasts; reused ones count once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return sum("Exchange " in line and "Broadcast" not in line and "Reused" not in line for line in plan.splitlines())


def test_quantiles_deal_out_no_rows(spark, long_df):
    from tideline.operators.cleaning import impute_for_training, quality_report
    from tideline.operators.selection import mutual_information

    df = long_df.withColumn("word", F.col("asset"))
    assert exchanges(exact_quantiles(df, ["asset"], "close", {"m": 0.5})) <= 3
    assert exchanges(quality_report(df, ["open", "close"])) <= 12
    assert exchanges(impute_for_training(df, ["open", "high"], "close", ["word"])) <= 12
    assert exchanges(mutual_information(df, ["open", "high"], "close")) <= 12


def test_ranks_match_pandas(spark):
    pdf, df = hot(spark, 3000)
    got = average_ranks(df, ["k"], "v", "r").toPandas()
    pdf["r"] = pdf.groupby("k").v.rank()
    want = pdf.dropna().drop_duplicates(["k", "v"])
    both = want.merge(got, on=["k", "v"])
    assert len(both) == len(want) == len(got)
    same(both.r_x, both.r_y)


def test_auc_and_rank_ic(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"fold": 0, "y_true": rng.integers(0, 2, 500), "y_prob": np.round(rng.random(500), 2)})
    got = roc_auc(spark.createDataFrame(pdf), ["fold"]).first()["roc_auc"]
    pos, neg = pdf.y_prob[pdf.y_true == 1].values, pdf.y_prob[pdf.y_true == 0].values
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12
    preds = spark.createDataFrame(pd.DataFrame({"fold": 0, "y_true": np.round(rng.normal(size=300), 1), "y_pred": np.round(rng.normal(size=300), 1)}))
    a, b = (f(preds, ["fold"]).first()["ic"] for f in (rank_ic, rank_ic_large))
    p = preds.toPandas()
    assert abs(a - p.y_true.rank().corr(p.y_pred.rank())) < 1e-12 and abs(a - b) < 1e-12


def test_salted_join_keeps_every_row(spark):
    pdf, df = hot(spark, 3000)
    df = df.withColumn("id", F.monotonically_increasing_id())
    stats = df.filter("k <> 'y'").groupBy("k").agg(F.avg("v").alias("m"))
    assert join_stats(df, stats, ["k"], "left", ["id"]).count() == 3000
    assert join_stats(df, stats, ["k"], "left_semi", ["id"]).count() == (pdf.k != "y").sum()


def test_range_join_is_brute_force(spark):
    rows = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("p"))
    ranges = [("a", 0, 0, 700), ("a", 1, 650, 651), ("a", 2, 10, 10), ("a", 3, 990, 2000), ("b", 4, 0, 5)]
    r = spark.createDataFrame(ranges, "k string, f int, lo bigint, hi bigint")
    got = {(x["f"], x["p"]) for x in range_join(rows, r, ["k"], "p", "lo", "hi", 64).collect()}
    assert got == {(f, p) for k, f, lo, hi in ranges if k == "a" for p in range(lo, min(hi, 1000))}
