"""File sources and sinks.

Every reader takes an explicit schema: inference costs a full extra pass over
the input and gives different types on different samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
             encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """CSV with a header row (S1); ``encoding="ISO-8859-1"`` reads latin-1 files."""
    return (spark.read.schema(schema)
            .option("header", header).option("encoding", encoding).option("sep", sep)
            .option("mode", "PERMISSIVE").csv(path))


def wide_schema(num_features: int, response: str = "y", prefix: str = "x") -> T.StructType:
    """Generated names for a headerless numeric table: response first, then x0..x{n-1}."""
    fields = [T.StructField(response, T.DoubleType(), True)]
    fields += [T.StructField(f"{prefix}{i}", T.DoubleType(), True) for i in range(num_features)]
    return T.StructType(fields)


def read_pipe_table(spark: SparkSession, path: str, num_features: int, response: str = "y") -> DataFrame:
    """Headerless pipe-delimited numeric table with generated column names (S3)."""
    return read_csv(spark, path, wide_schema(num_features, response), header=False, sep="|")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Generic reader for the product / sales style tables."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                **options) -> None:
    """Result tables instead of printed reports (S6). CSV/JSON/text keep one file per task."""
    df.write.mode(mode).format(fmt).options(**options).save(path)
