"""Null labels, null groups, a third group and offsets in the test statistics."""

import pytest

from tessera.operators import evaluate, htest


def test_auc_leaves_out_null_labels(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (1, 0.6), (None, 0.65), (None, 0.95)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()["auc"] == pytest.approx(4 / 6)
    assert max(r["tpr"] for r in evaluate.roc_points(df, "y", "s").collect()) == 1.0


def test_kruskal_leaves_out_the_null_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 2.5)]
    with_null = spark.createDataFrame([*rows, (None, 9.0), (None, 8.0)], "g string, v double")
    clean = spark.createDataFrame(rows, "g string, v double")
    assert htest.kruskal(with_null, "g", "v", with_p=False).first() == htest.kruskal(clean, "g", "v", with_p=False).first()


def test_t_test_needs_two_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), (None, 100.0)]
    got = htest.t_test(spark.createDataFrame(rows, "g string, v double"), "g", "v", with_p=False).first()
    assert (got["group_a"], got["group_b"], got["n_a"], got["n_b"]) == ("a", "b", 2, 2)
    with pytest.raises(Exception, match="two groups"):
        htest.t_test(spark.createDataFrame([*rows, ("c", 1.0), ("c", 3.0)], "g string, v double"), "g", "v", with_p=False).collect()


def test_pearson_counts_known_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 1.0), (4.0, None)], "x double, y double")
    assert htest.pearson(df, "x", "y").first()["n"] == 3


def test_profile_of_an_offset_column(spark):
    from pyspark.sql import functions as F
    df = spark.range(2000).select((F.randn(7) + 1e7).alias("v"))
    got = htest.distribution_profile(df, "v").first()
    assert abs(got["skewness"]) < 0.3 and abs(got["kurtosis"] - 3) < 0.5


def test_ols_of_an_offset_predictor(spark):
    from tessera.operators import models
    df = spark.createDataFrame([(1e8 + i / 100, 3.0 * i / 100) for i in range(101)], "x double, y double")
    fit = models.ols(df, "y", ["x"])
    assert fit.coef[1] == pytest.approx(3.0, rel=1e-6) and fit.rank == 2


def test_ols_reports_the_rank_of_collinear_predictors(spark):
    from tessera.operators import models
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, i + 1.0) for i in range(20)], "a double, b double, c double, y double")
    fit = models.ols(df, "y", ["a", "b", "c"])
    assert fit.rank == 2 and fit.df_resid == 18
    assert fit.coef[1] + 2 * fit.coef[2] == pytest.approx(1.0)


def test_corr_pairs_with_nulls_and_a_constant(spark):
    import numpy as np
    from tessera.operators import prep
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 40))
    rows = [(float(x), float(y), None if i % 4 == 0 else float(z), 1.0) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    for per_pass in (500, 2):
        got = {(r["feature_a"], r["feature_b"]): r["r"] for r in prep.corr_pairs(df, ["a", "b", "c", "k"], False, per_pass).collect()}
        assert got["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1])
        some = np.arange(40) % 4 != 0
        assert got["a", "c"] == pytest.approx(np.corrcoef(a[some], c[some])[0, 1])
        assert got["a", "k"] is None and len(got) == 6


def test_kde_of_an_outlier_keeps_its_grid(spark):
    import numpy as np
    from tessera.operators import summary
    v = np.r_[np.random.default_rng(5).normal(size=500), 1000.0]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = sorted((r["point"], r["x"], r["density"]) for r in summary.kde(df, "v").collect())
    h = v.std(ddof=1) * len(v) ** -0.2
    assert len(got) == 64
    for _, x, d in got:
        assert d == pytest.approx(np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)), rel=1e-9)


def test_shares_and_scaling_start_no_job(spark):
    from pyspark.sql import functions as F
    from tessera.operators import prep, summary
    group = "plans-only"
    spark.sparkContext.setJobGroup(group, group)
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    a, b = summary.with_share(df, "n"), prep.minmax_scale(df, "n")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert sum(r["pct"] for r in a.collect()) == pytest.approx(100) and b.count() == 3
