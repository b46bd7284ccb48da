"""Readers, writers and the streaming form of the row-wise cleaning."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.sources import files, standins
from tessera.streaming import clean_visits, read_visits_stream


def test_pipe_table_with_generated_names(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "y double, a double, b double")
    files.write_table(df, os.path.join(d, "wide"), "csv", header=False, sep="|")
    back = files.read_pipe_table(spark, os.path.join(d, "wide"), 2)
    assert back.columns == ["y", "x0", "x1"]
    assert sorted(tuple(r) for r in back.collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_latin1_csv(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    p = os.path.join(d, "loans.csv")
    with open(p, "wb") as fh:
        fh.write("id,emp_title\n1,Café owner\n".encode("latin-1"))
    df = files.read_csv(spark, p, "id long, emp_title string", encoding="ISO-8859-1")
    assert df.first()["emp_title"] == "Café owner"


def test_stream_cleaning_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    raw = standins.visits_raw_text(spark, SF_SMALL).withColumnRenamed("user_id", "user_id")
    raw.select("user_id", "date", "variant", "device_type", *[c for c in raw.columns if c.endswith(
        ("pageviews", "clicks", "shares", "reached"))]).write.mode("overwrite").json(os.path.join(d, "in"))
    stream = read_visits_stream(spark, os.path.join(d, "in"))
    q = stream.writeStream.format("memory").queryName("visits_clean").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM visits_clean")
    batch = clean_visits(raw)
    assert got.count() == batch.count()
    assert got.agg(F.sum("total_pageviews")).first()[0] == batch.agg(F.sum("total_pageviews")).first()[0]
