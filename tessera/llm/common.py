"""Helpers shared by the pipeline operators: intermediate tables in the shared
folder, hot-key tables, private column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Hot-key tables of at most this many rows are broadcast; larger ones are joined by a shuffle.
MAX_HOT_KEYS = 20_000


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def save(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost
    executor costs no recomputation. ``level`` of the compression."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private(columns: Iterable[str], *names: str) -> list[str]:
    """Names like ``names`` that clash with none of ``columns`` (compared without case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(key: Column, m: int) -> Column:
    """``crc32(key as text) mod m``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(m)


def hot_keys(df: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """Keys with more than ``limit`` rows and their count ``n_rows``. Counted with map-side
    sums, then written; broadcast later only if the written table is proven small."""
    hot = save(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit), name)
    return F.broadcast(hot) if hot.count() <= MAX_HOT_KEYS else hot
