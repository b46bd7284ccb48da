"""Inputs of fits: bounded parts, bounded memory of fits that run together, frames written once."""

from pyspark.sql import functions as F

from tessera.operators import _util, evaluate, models
from tessera.operators import smote as S
from tessera.plans import studies
from tessera.session import materialize


def test_parts_of_a_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(_util, "TASK_ROWS", 100)
    written = materialize(spark.range(1000).repartition(2))
    got = _util.spread(written)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 110
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    few = materialize(spark.range(100).repartition(2))
    assert _util.spread(few) is few
    empty = materialize(spark.range(0))
    assert _util.spread(empty) is empty


def test_forest_of_the_ranking_reads_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(_util, "TASK_ROWS", 100)
    seen = []
    fit = models.fit_pipeline
    monkeypatch.setattr(models, "fit_pipeline", lambda df, stages: seen.append(
        df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]) or fit(df, stages))
    d = spark.range(0, 1000, numPartitions=1).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                                     F.col("id").cast("double").alias("y"))
    assert studies.feature_ranking(d, "y", ["a", "b"], forest_depth=2).count() > 0
    assert seen and max(seen) <= 110


def test_large_fits_run_one_after_another():
    assert models.together(1000, 50, 9) == 9
    assert models.together(10**9, 50, 9) == 1
    assert models.together(0, 50, 5) == 5
    assert models.together(5_000_000, 100, 9) == 3


def test_boosting_keeps_no_node_ids():
    assert not models.gbt(["x"], "y", 5, 2)[-1].getCacheNodeIds()


def test_levels_alone_give_the_encoders(spark):
    rows = [("a", "y", "g", "d", "f", float(i % 3), i) for i in range(20)] + [("b", "n", "h", "e", "t", 1.0, 20)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in studies._CAT) + ", length double, id long")
    whole = studies.purchase_encoders(df)[0].labelsArray
    assert whole == studies.purchase_encoders(df.select(*studies._CAT).distinct())[0].labelsArray


def test_auc_with_ties_and_nulls(spark):
    rows = [("x", 1, 0.5), ("x", 0, 0.5), ("x", 1, 0.9), ("x", 0, 0.1), ("x", None, 0.2), ("x", 1, None), ("one", 1, 0.3)]
    df = spark.createDataFrame(rows, "s string, y int, p double")
    got = {r["s"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in evaluate.auc(df, "y", "p", "s").collect()}
    assert got == {"x": (2, 2, 0.875), "one": (1, 0, None)}
    r = evaluate.auc(df.limit(0), "y", "p").first()
    assert (r["n_pos"], r["n_neg"], r["auc"]) == (0, 0, None)


def test_only_wanted_points_are_searched_for(spark):
    rows = [(i, [float(i), 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    got = {r["point"]: [(n["point"], n["vec"]) for n in r["near"]] for r in S.neighbours(df, "key", k=2, asked=F.col("key") == 7).collect()}
    assert set(got) == {7} and sorted(got[7]) == [(6, [6.0, 0.0]), (8, [8.0, 0.0])]


def test_no_point_is_lost_where_keys_repeat(spark):
    points = spark.range(3000).select(F.lit(1).cast("long").alias("point"), F.lit(1).cast("long").alias("copies"),
                                      F.array(F.rand(1), F.rand(2)).alias("vec"))
    held = S.leaves(materialize(points), 2, trees=2, leaf=500)
    assert held.groupBy("tree").count().orderBy("tree").collect() == [(0, 3000), (1, 3000)]


def test_forests_keep_no_node_ids(spark):
    assert not models.forest_classifier(["x"], "y", 5)[-1].getCacheNodeIds()


def test_model_input_is_written_as_numbers_of_levels(spark, monkeypatch):
    rows = [("a", "y", "g", "d", "f", float(i % 3), i % 2) for i in range(20)] + [("b", "n", "h", "e", "t", 1.0, 1), (None, "n", "h", "e", "t", 2.0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in studies._CAT) + ", length double, purchased int")
    encoders = studies.purchase_encoders(df.select(*studies._CAT).distinct())
    from pyspark.ml import PipelineModel
    want = [r.features for r in PipelineModel(encoders).transform(df).select("features").collect()]
    held = []
    monkeypatch.setattr(studies, "materialize", lambda d: held.append(d.schema.simpleString()) or materialize(d))
    coded = studies.purchase_encoded(encoders, df, "purchased")
    assert [r.features for r in coded.collect()] == want and coded.columns == ["purchased", "features"]
    assert len(held) == 1 and "vector" not in held[0] and "string" not in held[0]
