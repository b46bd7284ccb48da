"""Scalar expressions on the hand-made edge tables."""

from pyspark.sql import functions as F

from tessera.functions import scalar as X


def test_tolerant_casts_and_dates(spark):
    df = spark.createDataFrame([("3.7", "20240105"), ("x", "2024-01-05"), (None, None), ("", "20241340")],
                               "s string, d string")
    got = df.select(X.to_int("s").alias("i"), X.parse_date("d", "yyyyMMdd").alias("d")).collect()
    assert [r["i"] for r in got] == [3, None, None, None]
    assert str(got[0]["d"]) == "2024-01-05"
    assert [r["d"] for r in got[1:]] == [None, None, None]


def test_digits_from_text(spark):
    df = spark.createDataFrame([("< 1 year",), ("10+ years",), ("3 years",), ("n/a",), (None,)], "s string")
    got = [r[0] for r in df.select(X.digits_from_text("s")).collect()]
    assert got == [0, 10, 3, None, None]


def test_parse_list(spark):
    df = spark.createDataFrame([(1, '["a", \'b\']'), (2, "[]"), (3, "['a','a']")], "id long, s string")
    got = {r["id"]: r["l"] for r in df.select("id", X.parse_list("s").alias("l")).collect()}
    assert got[1] == ["a", "b"]
    assert got[2] == [None]
    assert got[3] == ["a", "a"]


def test_words_and_buckets(spark):
    df = spark.createDataFrame([("Murad Pore Reform™ Skin-Smoothing!",), ("",), ("123 456",)], "s string")
    got = [r[0] for r in df.select(X.words("s")).collect()]
    assert got == [["murad", "pore", "reform", "skin", "smoothing"], [], []]
    q = spark.createDataFrame([(1.0,), (9.0,), (10.0,), (37.0,)], "q double")
    assert [r[0] for r in q.select(X.count_bucket("q")).collect()] == ["1", "9", ">=10", ">=10"]
    assert [r[0] for r in q.select(X.binarise("q")).collect()] == [1, 1, 1, 1]


def test_mapping_and_rounding(spark):
    df = spark.createDataFrame([("male", 2.5), ("female", 3.5), ("other", -2.5)], "g string, x double")
    got = df.select(X.replace_values("g", {"male": 1, "female": 0}).alias("m"),
                    X.round_half_even("x", 0).alias("r"),
                    X.group_values("g", {"person": ["male", "female"]}).alias("grp")).collect()
    assert [r["m"] for r in got] == [1, 0, None]
    assert [r["r"] for r in got] == [2.0, 4.0, -2.0]
    assert [r["grp"] for r in got] == ["person", "person", "other"]


def test_fill_by_type(spark):
    df = spark.createDataFrame([(None, None, 1)], "a double, b string, c int")
    r = X.fill_by_type(df).first()
    assert (r["a"], r["b"], r["c"]) == (-2.0, "-2", 1)
