"""Sampling invariants and evaluation metrics against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, sampling


def _labels(spark, n=500, pos_share=0.2, seed=1):
    rnd = random.Random(seed)
    rows = [(i, int(rnd.random() < pos_share), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, x double")


def test_stratified_split_is_exact_and_partition_invariant(spark):
    df = _labels(spark)
    a = sampling.stratified_split(df, "y", "id", 0.2, 42)
    b = sampling.stratified_split(df.repartition(7), "y", "id", 0.2, 42)
    ca = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    for cls, n in sizes.items():
        assert ca[(cls, "train")] == round(n * 0.8)
    ka = {r["id"]: r["split"] for r in a.collect()}
    kb = {r["id"]: r["split"] for r in b.collect()}
    assert ka == kb


def test_folds_partition_rows(spark):
    df = _labels(spark)
    f = sampling.stratified_folds(df, "y", "id", 5, 42)
    assert f.count() == df.count()
    per = f.groupBy("y", "fold").count().collect()
    for cls in (0, 1):
        counts = [r["count"] for r in per if r["y"] == cls]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_under_and_over_sampling_balance(spark):
    df = _labels(spark)
    u = {r["y"]: r["count"] for r in sampling.undersample(df, "y", "id").groupBy("y").count().collect()}
    o = {r["y"]: r["count"] for r in sampling.oversample(df, "y", "id").groupBy("y").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert u[0] == u[1] == min(sizes.values())
    assert o[0] == o[1] == max(sizes.values())
    # the oversampled minority only holds original minority rows
    ids = {r["id"] for r in df.where("y = 1").collect()}
    got = {r["id"] for r in sampling.oversample(df, "y", "id").where("y = 1").collect()}
    assert got <= ids


def _brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_rank_form_equals_pairwise_with_ties(spark):
    rnd = random.Random(5)
    pairs = [(int(rnd.random() < 0.4), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "y int, s double")
    got = evaluate.auc(df, "y", "s").first()["auc"]
    assert got == pytest.approx(_brute_auc(pairs), rel=1e-12)
    # trapezoid area over the ROC points gives the same number
    pts = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(df, "y", "s").collect())
    pts = [(0.0, 0.0)] + pts
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    assert area == pytest.approx(got, rel=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()["auc"] is None


def test_threshold_sweep(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.35), (0, 0.1), (1, 0.5)]
    df = spark.createDataFrame(pairs, "y int, s double")
    got = {r["threshold"]: r for r in evaluate.threshold_sweep(df, "y", "s", (0.3, 0.5)).collect()}
    assert (got[0.5]["tp"], got[0.5]["fp"], got[0.5]["tn"], got[0.5]["fn"]) == (1, 1, 1, 2)
    assert got[0.3]["accuracy"] == pytest.approx(4 / 5)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    sse = 0.25 + 0.25 + 0.25
    assert r["rmse"] == pytest.approx((sse / 3) ** 0.5)
    assert r["r2"] == pytest.approx(1 - sse / 2.0)


def test_hash_split_affine_is_portable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = sampling.hash_split(df, "k", 0.1, 42, method="affine")
    expect = sum(1 for k in range(1000) if ((k % 1000003) * 7919 + 42) % 1000003 / 1000003 < 0.1)
    assert s.where(F.col("split") == "test").count() == expect


def test_kde_integrates_to_one_and_sums_every_value(spark):
    import math
    rnd = random.Random(4)
    vals = [rnd.gauss(10, 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from tessera.operators import summary
    pts = sorted((r["x"], r["density"]) for r in summary.kde(df, "x", grid=50).collect())
    step = pts[1][0] - pts[0][0]
    area = sum(d for _, d in pts) * step
    assert 0.9 < area < 1.01  # grid spans min..max only
    n, mean = len(vals), sum(vals) / len(vals)
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / (n - 1))
    h = sd * n ** -0.2
    x = pts[25][0]
    exact = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in vals) / (n * h * math.sqrt(2 * math.pi))
    assert pts[25][1] == pytest.approx(exact, rel=1e-9)


def test_bootstrap_interval_is_stable_and_covers_the_rate(spark):
    from tessera.operators import summary
    df = _labels(spark, 2000, 0.3).withColumn("grp", (F.col("id") % 3).cast("string"))
    a = {r["grp"]: (r["low"], r["high"]) for r in summary.bootstrap_interval(df, "grp", "y", 100, 7).collect()}
    b = {r["grp"]: (r["low"], r["high"]) for r in
         summary.bootstrap_interval(df.repartition(5), "grp", "y", 100, 7).collect()}
    assert a == b
    rates = {r["grp"]: r["r"] for r in df.groupBy("grp").agg(F.avg("y").alias("r")).collect()}
    for g, (lo, hi) in a.items():
        assert lo < rates[g] < hi


def test_auc_equals_spark_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(8)
    pairs = [(float(rnd.random() < 0.35), round(rnd.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "y double, s double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0)
    assert evaluate.auc(df, "y", "s").first()["auc"] == pytest.approx(ev.evaluate(df), rel=1e-9)


def test_select_first_per_class_equals_full_ranking(spark):
    from pyspark.sql import Window
    df = _labels(spark, 3000, 0.25, seed=9)
    keep = F.when(F.col("y") == 1, F.lit(137)).otherwise(F.round(F.col("class_n") * 0.3))
    sel = sampling.select_first_per_class(df, "y", "id", keep, seed=42, n_buckets=8)
    got = {r["id"] for r in sel.where("__selected").collect()}
    h = df.withColumn("__h", F.xxhash64("id", F.lit(42)))
    rn = F.row_number().over(Window.partitionBy("y").orderBy("__h", "id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("y"))
    brute = h.withColumn("rn", rn).withColumn("n", n).where(
        F.when(F.col("y") == 1, F.col("rn") <= 137).otherwise(F.col("rn") <= F.round(F.col("n") * 0.3)))
    assert got == {r["id"] for r in brute.collect()}


def test_folds_are_contiguous_blocks_of_the_hash_order(spark):
    from pyspark.sql import Window
    df = _labels(spark, 2003, 0.3, seed=10)
    got = {r["id"]: r["fold"] for r in sampling.stratified_folds(df, "y", "id", 5, 42, n_buckets=8).collect()}
    h = df.withColumn("__h", F.xxhash64("id", F.lit(42)))
    rn = F.row_number().over(Window.partitionBy("y").orderBy("__h", "id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("y"))
    for r in h.withColumn("rn", rn).withColumn("n", n).collect():
        size = [r["n"] // 5 + (1 if f < r["n"] % 5 else 0) for f in range(5)]
        bounds = [sum(size[:f + 1]) for f in range(5)]
        want = next(f for f in range(5) if r["rn"] <= bounds[f])
        assert got[r["id"]] == want
