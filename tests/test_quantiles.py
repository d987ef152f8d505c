import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agestrata.functions import quantiles
from agestrata.functions.quantiles import group_quantiles, interval_probabilities

PROBS = {"p0": 0.0, "p02": 0.025, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def _check(spark, frame, **options):
    df = spark.createDataFrame(frame).repartition(7)
    got = group_quantiles(df, ["k"], "v", PROBS, "mean", **options).toPandas().set_index("k")
    assert sorted(got.index) == sorted(frame.k.unique())
    for k, group in frame.groupby("k"):
        want = np.quantile(group.v, list(PROBS.values()))
        np.testing.assert_allclose(got.loc[k, list(PROBS)].astype(float), want, rtol=1e-12, atol=1e-12)
        assert got.loc[k, "mean"] == pytest.approx(group.v.mean())


def _frame(seed=3):
    rng = np.random.default_rng(seed)
    groups = {
        "one": [1.5],
        "two": [1.0, 4.0],
        "small": rng.normal(size=37),
        "bins": rng.normal(size=32),
        "more": rng.normal(size=1001),
        "large": rng.lognormal(size=40_000),
        # A third of the values are the same, and sit on a wanted rank.
        "ties": np.r_[np.full(10_000, 0.5), rng.uniform(size=20_000)],
        "few": rng.integers(0, 3, 25_000).astype(float),
        "sorted": np.arange(30_000.0),
        "outlier": np.r_[rng.normal(size=20_000), 1e15],
    }
    return pd.concat([pd.DataFrame({"k": k, "v": np.asarray(v, dtype=float)}) for k, v in groups.items()])


def test_selection_is_exact(spark):
    _check(spark, _frame())


@pytest.mark.parametrize("bins", [2, 5, 64])
def test_any_number_of_bins_is_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "ROWS", 100)
    _check(spark, _frame(4))


@pytest.mark.parametrize("cuts", [0, 1, 3])
def test_any_number_of_cuts_is_exact(spark, monkeypatch, cuts):
    """Ranks come from counts: poor bins only deal work out unevenly."""
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    monkeypatch.setattr(quantiles, "ROWS", 500)
    _check(spark, _frame(5))


def test_values_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROWS", 20)
    rng = np.random.default_rng(6)
    groups = {
        "ends": np.r_[rng.normal(size=300), -1.7e308, 1.7e308],
        "tiny": np.r_[np.zeros(100), 5e-324, -5e-324, rng.normal(size=50) * 1e-320],
        "scales": 10.0 ** rng.integers(-300, 300, 400),
        "same": np.full(200, 0.1),
    }
    frame = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    got = group_quantiles(spark.createDataFrame(frame), ["k"], "v", PROBS).toPandas().set_index("k")
    for k, group in frame.groupby("k"):
        np.testing.assert_allclose(got.loc[k].astype(float), np.quantile(group.v, list(PROBS.values())), rtol=1e-12, atol=0)
    df = spark.createDataFrame([(float("inf"),)] * 30 + [(float(i),) for i in range(50)], "v double").withColumn("k", F.lit(1))
    row = group_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.1}).first()
    assert row["a"] == 0.0 and row["b"] == 39.5 and row["c"] == pytest.approx(7.9)


def test_no_keys_is_one_group(spark, monkeypatch):
    for most in (10, 1000):
        monkeypatch.setattr(quantiles, "ROWS", most)
        df = spark.range(101).selectExpr("cast(id AS double) AS v")
        assert group_quantiles(df, [], "v", {"q": 0.25}, "m").first()[:] == (25.0, 50.0)


def test_a_group_of_a_million_values(spark):
    """Bins that hold a wanted rank, each of its values and no more than is stated."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e7).alias("v"))
    df = df.unionByName(spark.range(50).selectExpr("'b' AS k", "cast(id AS double) AS v"))
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", PROBS).collect()}
    want = np.quantile(df.where("k = 'a'").toPandas().v, list(PROBS.values()))
    np.testing.assert_allclose([got["a"][p] for p in PROBS], want, rtol=1e-12)
    df.withColumnRenamed("v", "_v").createOrReplaceTempView("_rows")
    spark.sql(f"""SELECT k, count(_v) AS _n, min(_v) AS lo, max(_v) AS hi, count(_v) AS c, 0L AS before
        FROM _rows WHERE k = 'a' GROUP BY k""").createOrReplaceTempView("_group")
    bins = spark.sql(quantiles._cut("_group", ["k"], ["100000", "_n div 2"])).collect()
    assert len(bins) == 2 and all(b["c"] <= quantiles.ROWS for b in bins)
    assert all(b["before"] < r <= b["before"] + b["c"] for b, r in zip(sorted(bins, key=lambda b: b["lo"]), (100_000, n // 2)))


def _shuffles(df):
    """Shuffles of the plan that ran, a reused one once."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("+- Exchange")


def test_small_groups_take_two_shuffles(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("id % 50 AS k", "cast(id AS double) AS v")
    assert _shuffles(group_quantiles(df, ["k"], "v", PROBS, "m")) <= 3


def test_no_job_runs_before_the_result_is_asked_for(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "cast(id AS double) AS v")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    out = group_quantiles(df, ["k"], "v", PROBS)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    assert out.count() == 2


def test_null_keys_are_groups(table):
    df = table([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r.k: r.q for r in group_quantiles(df, ["k"], "v", {"q": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_null_makes_a_group_null_unless_removed(table):
    df = table([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, v double")
    kept = group_quantiles(df, ["k"], "v", {"q": 0.5}, "m").toPandas().set_index("k")
    assert pd.isna(kept.loc["a", "q"]) and pd.isna(kept.loc["a", "m"])
    assert kept.loc["b", "q"] == 2.0
    out = group_quantiles(df, ["k"], "v", {"q": 0.5}, "m", na_rm=True)
    out = out.toPandas().set_index("k")
    assert out.loc["a", "q"] == 1.0 and out.loc["a", "m"] == 1.0
    assert pd.isna(out.loc["c", "q"])


def test_interval_probabilities():
    assert interval_probabilities(80) == {"Lo": 0.1, "Hi": 0.9}
    assert interval_probabilities(95) == {"Lo": 0.025, "Hi": 0.975}
