"""Null rules, exact distributions, draws, plans without raw-row shuffles, order-dependent sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import basket, evaluate, htest, models, prep, profile, rank, sampling, summary


def test_threshold_sweep_leaves_out_null_labels(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.9), (None, 0.1), (1, None)], "y int, s double")
    r = evaluate.threshold_sweep(df, "y", "s", [0.5]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["accuracy"]) == (1, 0, 1, 0, 1.0)


def test_regression_metrics_count_known_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (5.0, None), (None, 1.0)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    assert r["n"] == 2 and r["rmse"] == pytest.approx(math.sqrt(0.5))


def test_f_scores_and_pearson_with_nulls_and_constants(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, 4.5, 7.0), (3.0, 5.0, 7.0), (None, 1.0, 7.0), (4.0, None, 7.0)]
    df = spark.createDataFrame(rows, "x double, y double, k double")
    got = {r["feature"]: r for r in htest.f_scores(df, "y", ["x", "k"], with_p=False).collect()}
    r = np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1]
    assert got["x"]["n"] == 3 and got["x"]["f"] == pytest.approx(r * r / (1 - r * r))
    assert got["k"]["r"] is None and got["k"]["f"] is None
    assert htest.pearson(df, "k", "y").first()["r"] is None
    assert summary.regression_lines(df, "k", "y").first()["r"] is None


def test_thousand_columns_in_one_scan(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 1000)) * rng.uniform(0.1, 10, 1000) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[::7, 3] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"c{i} double" for i in range(1000)))
    pairs = prep.corr_pairs(df, df.columns, absolute=False)
    assert pairs.count() == 999 * 500
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in pairs.where("feature_a in ('c0', 'c3')").collect()}
    known = ~np.isnan(x[:, 3])
    assert got["c0", "c1"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=1e-9)
    assert got["c3", "c9"] == pytest.approx(np.corrcoef(x[known, 3], x[known, 9])[0, 1], abs=1e-9)


@pytest.mark.parametrize("n, v, p", [(6, 0, 0.03125), (8, 3, 0.0390625), (10, 8, 0.048828125), (5, 0, 0.0625)])
def test_signed_rank_exact_critical_values(spark, n, v, p):
    """Published two-sided tail probabilities of the signed-rank sum."""
    ranks, left = set(), v
    for r in range(n, 0, -1):
        if r <= left:
            ranks.add(r)
            left -= r
    df = spark.createDataFrame([(float(r) if r in ranks else 0.0, 0.0 if r in ranks else float(r)) for r in range(1, n + 1)], "a double, b double")
    got = htest.signed_rank(df, "a", "b").first()
    assert got["exact"] and got["v_stat"] == v and got["p_value"] == pytest.approx(p)


def test_signed_rank_is_approximated_with_ties_zeros_or_many_pairs(spark):
    ties = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (5.0, 1.0)], "a double, b double")
    zero = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0), (5.0, 1.0)], "a double, b double")
    many = spark.createDataFrame([(float(i * i), float(i)) for i in range(2, 60)], "a double, b double")
    assert [htest.signed_rank(d, "a", "b").first()["exact"] for d in (ties, zero, many)] == [False] * 3


def test_poisson_draws_of_small_cells(spark):
    """Means of 1 to 5 and one beyond the inversion: mean, variance and the share of zeros."""
    for n in (1, 2, 5, 300, 5000):
        u = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
        if n <= summary.POISSON_EXACT:
            m = u.select(summary.poisson_draw(F.lit(n), F.col("u")).alias("m"))
        else:
            m = spark.range(20000).select(summary.poisson_far(F.lit(n), F.rand(1), F.rand(2)).alias("m"))
        r = m.agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.avg((F.col("m") == 0).cast("double")).alias("zero")).first()
        assert r["mean"] == pytest.approx(n, rel=0.01) and r["var"] == pytest.approx(n, rel=0.05)
        assert r["zero"] == pytest.approx(math.exp(-n), abs=2e-3)


def test_bootstrap_of_a_single_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), ("c", None)], "g string, y int")
    got = {r["g"]: (r["low"], r["high"]) for r in summary.bootstrap_interval(df, "g", "y", 100, 7).collect()}
    assert got["a"] == (1.0, 1.0) and got["b"] == (0.0, 1.0) and set(got) == {"a", "b"}


def test_residual_ks_with_a_null_scope_and_no_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(s, float(v)) for s in ("x", None) for v in rng.normal(size=60)] + [("flat", 1.0)] * 5
    got = {r["s"]: r for r in htest.residual_ks(spark.createDataFrame(rows, "s string, v double"), "v", None, "s").collect()}
    assert set(got) == {"x", None, "flat"} and got[None]["n"] == 60 and got["flat"]["ks_statistic"] is None
    assert 0.05 < got["x"]["ks_statistic"] < 0.2 and got["x"]["p_value"] > 0.05
    skewed = spark.createDataFrame([(float(v),) for v in rng.exponential(size=400) ** 2], "v double")
    assert htest.residual_ks(skewed, "v", None).first()["p_value"] < 1e-6


def test_durbin_watson_over_partitions(spark):
    e = np.cumsum(np.random.default_rng(5).normal(size=500))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "i int, e double").repartition(7)
    got = models.durbin_watson(df, "e", "i").first()
    assert got["n"] == 500 and got["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e * e).sum())
    assert models.durbin_watson(df.limit(0), "e", "i").first()["n"] == 0


def moved_rows(df):
    """Exchanges of the plan that take rows from a scan without an aggregate between; broadcasts and
    the rows of a cut bucket (under a filter on its rows alone) are not counted."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange" not in line or "BroadcastExchange" in line:
            continue
        for below in lines[i + 1:]:
            if "HashAggregate" in below or "ExistingRDD" in below:
                break
            if "FileScan" in below:
                out.append(line)
                break
    return out


def test_no_raw_rows_are_shuffled(spark, tmp_path):
    """Without automatic broadcasts, joins of raw rows with their few targets still move none."""
    spark.range(20000).select((F.col("id") % 3).alias("g"), F.rand(3).alias("v"), "id").write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (rank.exact_quantiles(raw, "v", [0.25, 0.5], "g"), summary.box_summary(raw, "v", "g"),
                    prep.impute(raw, ["v"], "median", "g"), profile.describe_numeric(raw, ["v"], "g"),
                    htest.levene(raw, "g", "v", with_p=False), htest.residual_moments(raw, "v", "g", with_p=False)):
            assert not moved_rows(out) and out.count()
        split = sampling.stratified_split(raw, "g", "id")
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and len(moved_rows(split)) <= 1  # the cut buckets alone
        assert split.where("split = 'train'").count() == 16001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_oversample_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "NUMBER_ROWS", 10)
    df = spark.createDataFrame([(i, int(i < 97)) for i in range(1000)], "id long, y int")
    a = sorted(r["id"] for r in sampling.oversample(df, "y", "id").where("y = 1").collect())
    assert len(a) == 903 and set(a) <= set(range(97)) and len(set(a)) > 90
    assert a == sorted(r["id"] for r in sampling.oversample(df.repartition(7), "y", "id").where("y = 1").collect())


def test_split_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(200)], "id long, y int")
    got = sampling.stratified_split(df, "y", "id", 0.2)
    assert got.count() == 200
    assert {r["y"]: r["n"] for r in got.where("split = 'train'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {None: 40, 0: 40, 1: 80}
    assert sampling.stratified_folds(df, "y", "id", 5).count() == 200


def test_rules_of_a_long_item_set(spark):
    """31 items in one set: rules grow from their consequents, cut by confidence."""
    items = [f"i{k:02d}" for k in range(31)]
    sets = [([x], 0.5) for x in items] + [(items, 0.01)] + [(items[:2], 0.4), (items[:3], 0.36), (items[1:3], 0.4), ([items[0], items[2]], 0.4)]
    df = spark.createDataFrame([(s, p, len(s)) for s, p in sets], "items array<string>, support double, size int").withColumn("key", basket.item_key(F.col("items")))
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["confidence"] for r in basket.association_rules(df, "confidence", 0.75).collect()}
    a, b, c = items[:3]
    assert got == {((a,), (b,)): 0.8, ((b,), (a,)): 0.8, ((b,), (c,)): 0.8, ((c,), (b,)): 0.8, ((a,), (c,)): 0.8, ((c,), (a,)): 0.8,
                   ((a, b), (c,)): pytest.approx(0.9), ((a, c), (b,)): pytest.approx(0.9), ((b, c), (a,)): pytest.approx(0.9)}
