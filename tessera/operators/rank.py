"""Distributed mid-ranks, cumulative counts and exact quantiles.

A global ``rank()`` over an unpartitioned window sorts every row in one task.
Instead ranks are derived from the value histogram:

1. ``(scope, value) -> t`` : rows per distinct value (partial aggregation, so a
   value holding a third of all rows is one histogram row);
2. cumulative count of smaller values within the scope, computed in
   quantile buckets: bucket totals (|scope| x buckets rows) get a running sum
   for the offset, and a window partitioned by (scope, bucket) adds the local
   running sum — no task ever sees more than one bucket of distinct values;
3. mid-rank = below + (t + 1) / 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators._util import as_list, counted_side


def bucket_splits(src: DataFrame, col: str, n_buckets: int = 128, sub_buckets: int = 64) -> list[float]:
    """Ordered bucket boundaries for ``col``: ``n_buckets`` approximate quantiles
    (one ``percentile_approx`` aggregate; n_buckets + 1 numbers reach the
    driver), each interval cut into ``sub_buckets`` equal-width pieces."""
    probs = [i / n_buckets for i in range(1, n_buckets)] or [0.5]
    b = src.agg(F.percentile_approx(col, probs, max(10000, 4 * n_buckets)).alias("s"),
                F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if b["lo"] is None:
        return [float("-inf"), 0.0, float("inf")]  # empty input: any valid split list
    edges = sorted({float(b["lo"]), *[float(x) for x in (b["s"] or [])], float(b["hi"])})
    inner = set(edges)
    for lo, hi in zip(edges, edges[1:]):
        step = (hi - lo) / sub_buckets
        inner.update(lo + j * step for j in range(1, sub_buckets))
    return [float("-inf"), *sorted(inner), float("inf")]


def cumulative_counts(ties: DataFrame, scope: Sequence[str], value: str, count,
                      n_buckets: int = 128, sub_buckets: int = 64, out="below",
                      bounds: tuple | None = None) -> DataFrame:
    """Add ``out`` = sum of ``count`` over strictly smaller ``value`` in the same scope.

    ``ties`` has one row per (scope, value). ``count``/``out`` may be lists to
    accumulate several columns in the same pass.

    Buckets are two-level: ``n_buckets`` quantile buckets from one
    ``percentile_approx`` aggregate (a bounded sketch; its n_buckets + 1 numbers
    are the only thing that reaches the driver), each cut into ``sub_buckets``
    equal-width pieces. A ``Bucketizer`` assigns the n_buckets x sub_buckets
    ordered buckets by binary search. The cumulative counts are exact whatever
    the boundaries are; the boundaries only balance the work.

    ``bounds=(frame, column)`` estimates the boundaries from the raw rows the
    histogram was built from (a narrow scan with map-side sketches) instead of
    from ``ties``, so the histogram shuffle runs once, not twice.
    """
    from pyspark.ml.feature import Bucketizer

    scope = as_list(scope)
    counts = [count] if isinstance(count, str) else list(count)
    outs = [out] if isinstance(out, str) else list(out)
    vd = "__vd"
    base = ties.withColumn(vd, F.col(value).cast("double"))
    if bounds is not None:
        src, col = bounds
        col = F.col(col) if isinstance(col, str) else col
        src = src.select(col.cast("double").alias(vd))
    else:
        src = base
    splits = bucket_splits(src, vd, n_buckets, sub_buckets)
    tb = Bucketizer(splits=splits, inputCol=vd, outputCol="__b", handleInvalid="keep").transform(base)
    btot = tb.groupBy(*scope, "__b").agg(*[F.sum(c).alias(f"__bt{i}") for i, c in enumerate(counts)])
    w_off = Window.partitionBy(*scope).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    boff = btot.select(*scope, "__b", *[F.coalesce(F.sum(f"__bt{i}").over(w_off), F.lit(0)).alias(f"__off{i}")
                                        for i in range(len(counts))])
    w_loc = Window.partitionBy(*scope, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    res = tb.join(boff, [*scope, "__b"])
    for i, (c, o) in enumerate(zip(counts, outs)):
        res = res.withColumn(o, F.col(f"__off{i}") + F.coalesce(F.sum(c).over(w_loc), F.lit(0)))
    return res.drop("__b", vd, *[f"__off{i}" for i in range(len(counts))])


def histogram_by(df: DataFrame, scope: Sequence[str], group: str | None, value: str,
                 weight: str | None = None) -> DataFrame:
    """(scope, group, __v, __n): rows per distinct value, NULL values and groups dropped.

    With ``weight`` the input is already a frequency table and the weights
    are summed (so tests can run on a pre-aggregated, reused table)."""
    scope = as_list(scope)
    g = [group] if group else []
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    known = F.col(value).isNotNull() & (F.col(group).isNotNull() if group else F.lit(True))
    return (df.where(known)
            .groupBy(*scope, *g, F.col(value).alias("__v")).agg(n.alias("__n")))


def midranks(hist: DataFrame, scope: Sequence[str], n_buckets: int = 128,
             bounds: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Mid-ranks of the values in ``hist`` (columns scope..., [group], __v, __n).

    Returns (hist with ``midrank``, ties table (scope, __v, __t, __below, midrank)).
    """
    scope = as_list(scope)
    ties = hist.groupBy(*scope, "__v").agg(F.sum("__n").alias("__t"))
    ranked = cumulative_counts(ties, scope, "__v", "__t", n_buckets, out="__below", bounds=bounds)
    ranked = ranked.withColumn("midrank", F.col("__below") + (F.col("__t") + 1) / 2.0)
    return hist.join(ranked.select(*scope, "__v", "__t", "midrank"), [*scope, "__v"]), ranked


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    scope: Sequence[str] | str | None = None, n_buckets: int = 128,
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / R type 7, DuckDB
    ``quantile_cont``) without sorting or gathering a group's values.

    1. rows per ordered bucket (map-side combined: at most |scope| x buckets rows);
    2. running offsets over those counts locate the bucket holding each target
       rank p (N - 1) (floor and ceiling);
    3. only the rows of those few buckets are ordered exactly, so the data shuffled for
       ordering is a tiny slice of the input however large it is. The target table (a row or
       two per scope and quantile) is written and counted; while it is small, rows are
       filtered against it in the scan, and no raw row is shuffled.
    ``weight``: ``df`` is a frequency table with that count column.
    Output: scope..., p, q.
    """
    from pyspark.ml.feature import Bucketizer

    from tessera.session import materialize

    scope = as_list(scope)
    w_col = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    base = df.where(F.col(value).isNotNull()).select(*scope, F.col(value).cast("double").alias("__v"),
                                                    w_col.alias("__w"))
    splits = bucket_splits(base, "__v", n_buckets)
    bk = Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep").transform(base)
    cnt = bk.groupBy(*scope, "__b").agg(F.sum("__w").alias("__c"))
    w_all = Window.partitionBy(*scope)
    w_run = Window.partitionBy(*scope).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = (cnt.withColumn("__off", F.coalesce(F.sum("__c").over(w_run), F.lit(0)))
           .withColumn("__N", F.sum("__c").over(w_all)))
    pos = F.col("p") * (F.col("__N") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    in_bucket = lambda idx: (F.col("__off") <= idx) & (idx < F.col("__off") + F.col("__c"))
    targets = (cnt.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .where(in_bucket(lo) | in_bucket(hi))
               .select(*scope, "__b", "p", "__off", lo.alias("__lo"), hi.alias("__hi"), (pos - lo).alias("__frac")))
    targets = materialize(targets)
    need = counted_side(targets.select(*scope, "__b").distinct())
    wl = Window.partitionBy(*scope, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    hist = (bk.join(need, [*scope, "__b"], "left_semi")
            .groupBy(*scope, "__b", "__v").agg(F.sum("__w").alias("__t"))
            .withColumn("__local", F.coalesce(F.sum("__t").over(wl), F.lit(0))))
    j = hist.join(targets, [*scope, "__b"]).withColumn("__below", F.col("__off") + F.col("__local"))
    covers = lambda idx: (F.col("__below") <= idx) & (idx < F.col("__below") + F.col("__t"))
    agg = (j.groupBy(*scope, "p")
           .agg(F.max(F.when(covers(F.col("__lo")), F.col("__v"))).alias("__vlo"),
                F.max(F.when(covers(F.col("__hi")), F.col("__v"))).alias("__vhi"),
                F.first("__frac").alias("__frac")))
    return agg.select(*scope, "p",
                      (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac")).alias("q"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     by: Sequence[str] | str | None = None, n_buckets: int = 128) -> DataFrame:
    """Exact quantiles of several columns at once: (by..., column, p, q).

    The columns are unpivoted to (column, value) and ranked with ``column`` as an
    outer scope, so one pipeline serves every column."""
    by = as_list(by)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("__val")) for c in cols])
    long = df.select(*by, F.explode(items).alias("__s")).select(*by, "__s.*")
    return exact_quantiles(long, "__val", probs, [*by, "column"], n_buckets)


def quartile_columns(q: DataFrame, keys: Sequence[str], names=("q1", "median", "q3"),
                     probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Long (keys, p, q) -> one row per key with a column per probability."""
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n)
                                  for n, p in zip(names, probs)])
