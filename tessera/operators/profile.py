"""Table inspection and data-quality profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators._util import as_list, attach_scalars, unpivot_row


def overview(df: DataFrame) -> DataFrame:
    """Columns, types, positions and the row count in one table."""
    entries = {f.name: {"position": F.lit(i), "dtype": F.lit(f.dataType.simpleString())}
               for i, f in enumerate(df.schema.fields)}
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return unpivot_row(counted, ["n_rows"], entries, label="column")


def head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows; with ``order_by`` the result is deterministic (a top-n)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, with the percentage of rows (P2, P3). One pass."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"__n_{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    entries = {c: {"n_null": F.col(f"__n_{i}")} for i, c in enumerate(cols)}
    return (unpivot_row(wide, ["n_rows"], entries)
            .withColumn("pct_null", F.try_divide(F.col("n_null") * 100.0, F.col("n_rows"))))


def any_null_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows with at least one null, in percent."""
    from tessera.operators._util import null_any
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(null_any(cols)).alias("n_rows_with_null"),
                  (F.avg(null_any(cols).cast("double")) * 100.0).alias("pct_rows_with_null"))


def key_check(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Is ``key`` unique? (P5). ``approximate`` uses HyperLogLog instead of an exact distinct."""
    distinct = (F.approx_count_distinct(key) if approximate else F.countDistinct(key))
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_distinct"))
            .withColumn("is_unique", F.col("n_rows") == F.col("n_distinct")))


def coverage(used: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Distinct keys used vs distinct keys in the catalogue, and the percentage.

    Two global aggregates; the second is attached as a one-row broadcast.
    """
    a = used.agg(F.countDistinct(key).alias("n_used"))
    b = catalogue.agg(F.countDistinct(key).alias("n_catalogue"))
    return (attach_scalars(a, b)
            .withColumn("pct_used", F.try_divide(F.col("n_used") * 100.0, F.col("n_catalogue"))))


def value_counts(df: DataFrame, col: str, normalize: bool = False, total: str = "n_total") -> DataFrame:
    """Count per value (P7); with ``normalize`` the share of all rows.

    The total is a count of the input's rows, attached as a scalar subquery; nothing runs while
    the plan is built.
    """
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        totals = df.agg(F.count(F.lit(1)).alias(total))
        out = attach_scalars(out, totals).withColumn("share", F.try_divide(F.col("n"), F.col(total)))
    return out


def describe_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None,
                     exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """count, mean, sd, min, q1, median, q3, max per column, optionally per group.

    Moments come from one wide aggregate. ``exact`` quartiles (linear
    interpolation, as pandas/R) come from the distributed rank machinery, so no
    task buffers all values of a group; ``exact=False`` uses ``percentile_approx``.
    """
    from tessera.operators.rank import column_quantiles, quartile_columns
    by = as_list(by)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"__cnt{i}"), F.avg(c).alias(f"__mean{i}"),
                 F.stddev_samp(c).alias(f"__sd{i}"), F.min(c).cast("double").alias(f"__min{i}"),
                 F.max(c).cast("double").alias(f"__max{i}")]
        if not exact:
            aggs.append(F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(f"__q{i}"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    entries = {}
    for i, c in enumerate(cols):
        e = {"count": F.col(f"__cnt{i}"), "mean": F.col(f"__mean{i}"), "std": F.col(f"__sd{i}"),
             "min": F.col(f"__min{i}"), "max": F.col(f"__max{i}")}
        if not exact:
            e.update({"q1": F.col(f"__q{i}")[0].cast("double"), "median": F.col(f"__q{i}")[1].cast("double"),
                      "q3": F.col(f"__q{i}")[2].cast("double")})
        entries[c] = e
    stats = unpivot_row(wide, by, entries)
    order = [*by, "column", "count", "mean", "std", "min", "q1", "median", "q3", "max"]
    if not exact:
        return stats.select(*order)
    q = quartile_columns(column_quantiles(df, cols, [0.25, 0.5, 0.75], by), [*by, "column"])
    return stats.join(q, [*by, "column"], "left").select(*order)


def describe_category(df: DataFrame, col: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """count, unique, top, freq of a categorical column, optionally per group.

    Ties for ``top`` go to the smallest value. Pre-counting (group, value) keeps
    the second aggregate small; a hot value is absorbed by partial aggregation.
    """
    by = as_list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    top = F.min_by(F.struct(F.col(col).alias("top"), F.col("__n").alias("freq")),
                   F.struct(-F.col("__n"), F.col(col)))
    agg = [F.sum("__n").alias("count"), F.count(F.lit(1)).alias("unique"), top.alias("__top")]
    out = counts.groupBy(*by).agg(*agg) if by else counts.agg(*agg)
    return out.select(*by, F.col("count").cast("long").alias("count"), "unique",
                      F.col("__top.top").alias("top"), F.col("__top.freq").alias("freq"))


def cell_sizes(df: DataFrame, cells: Sequence[str], id_col: str) -> DataFrame:
    """Rows and distinct ids per cell, and their ratio."""
    return (df.groupBy(*cells)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"))
            .withColumn("ids_per_row", F.col("n_ids") / F.col("n_rows")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
