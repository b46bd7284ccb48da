"""Streaming use of the row-wise operators.

The source analyses are batch only: their one "stream" reader loads a
newline-delimited JSON file in one go. Nothing stateful is claimed here. What
carries over unchanged is every row-wise step (tolerant casts, date parsing,
derived columns), because those are plain column expressions; this module
applies the visit-cleaning step to a file stream so new NDJSON files are
coerced as they land.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions import scalar as X

COUNT_FIELDS = ("total_pageviews", "shopping_pageviews", "ad_clicks", "shares", "bottom_of_page_reached",
                "bottom_related_link_clicks", "top_related_link_clicks")

# every field arrives as text, as in the NDJSON export the A/B analysis reads
RAW_VISIT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in ("user_id", "date", "variant", "device_type", *COUNT_FIELDS)])


def clean_visits(raw: DataFrame) -> DataFrame:
    """Coerce raw visit rows (X1, X2): integer counts, yyyyMMdd dates. Works on
    batch and streaming DataFrames alike."""
    return raw.select(X.to_int("user_id").alias("userid"), X.parse_date("date", "yyyyMMdd").alias("date"),
                      "variant", "device_type", *[X.to_int(c).alias(c) for c in COUNT_FIELDS])


def read_visits_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of cleaned visits from NDJSON files under ``path``."""
    r = spark.readStream.schema(RAW_VISIT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return clean_visits(r.json(path))
