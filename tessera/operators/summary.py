"""Grouped summaries, shares, first rows and distribution tables (A1-A12, W1, W2, W4, D1h-D6h)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators._util import as_list, attach_scalars, counted_side, pair_corr


def group_stats(df: DataFrame, by: Sequence[str] | str | None, value: str,
                prefix: str = "") -> DataFrame:
    """n, mean, sd and standard error sd/sqrt(n) of ``value`` per group (A3-A5)."""
    by = as_list(by)
    aggs = [F.count(value).alias(f"{prefix}n"), F.avg(value).alias(f"{prefix}mean"),
            F.stddev_samp(value).alias(f"{prefix}sd")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn(f"{prefix}se", F.col(f"{prefix}sd") / F.sqrt(F.col(f"{prefix}n")))


def with_share(df: DataFrame, value: str, within: Sequence[str] | str | None = None,
               name: str = "pct", scale: float = 100.0) -> DataFrame:
    """Percentage of ``value`` within a partition (A10, W2) or of the whole frame.

    Within groups: a window partitioned by the group key (spreads over tasks).
    Whole frame: a one-row total attached as a scalar subquery, never a global window.
    """
    within = as_list(within)
    if within:
        total = F.sum(value).over(Window.partitionBy(*within))
        return df.withColumn(name, F.try_divide(F.col(value) * scale, total))
    tot = df.agg(F.sum(value).alias("__total"))
    return (attach_scalars(df, tot)
            .withColumn(name, F.try_divide(F.col(value) * scale, F.col("__total"))).drop("__total"))


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order`` (W1). ``order`` must end in a unique
    tie-break column (defect D4).

    ``min_by(struct(*), struct(order))`` is an aggregate with a partial
    (map-side) phase, so a key holding a third of all rows is reduced before the
    shuffle; a ``row_number`` window would sort every row of that key in one task.
    """
    key = as_list(key)
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(best.alias("__row")).select(*key, "__row.*")


def class_rate(df: DataFrame, by: str, flag: Column, drop_zero: bool = True) -> DataFrame:
    """Rate of one class per group (A11); groups with no hit vanish as in
    ``value_counts(normalize=True).loc[:, cls]``."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return out.where(F.col("rate") > 0) if drop_zero else out


def rate_interval(df: DataFrame, by: str, flag: Column, z: float = 1.959963984540054) -> DataFrame:
    """Mean of a 0/1 flag per group with a normal 95 % interval (A12, deterministic form)."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))
    half = F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return out.withColumn("low", F.col("rate") - half).withColumn("high", F.col("rate") + half)


#: Means up to which Poisson draws are inverted term by term.
POISSON_EXACT = 400


def poisson_draw(mean: Column, u: Column) -> Column:
    """The Poisson quantile at ``u``: how many terms of the distribution function are at most ``u``.
    Terms are taken to 12 standard deviations above the mean."""
    n = mean.cast("double")
    last = F.ceil(n + 12 * F.sqrt(n) + 12).cast("int")
    start = F.struct(F.exp(-n).alias("p"), F.exp(-n).alias("cdf"), F.lit(0.0).alias("k"))
    step = lambda s, i: F.struct((s["p"] * n / i).alias("p"), (s["cdf"] + s["p"] * n / i).alias("cdf"),
                                 (s["k"] + F.when(s["cdf"] <= u, 1.0).otherwise(0.0)).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def poisson_far(mean: Column, u1: Column, u2: Column) -> Column:
    """A Poisson draw of a large mean from two uniforms: a normal number z, then
    n + sqrt(n) z + (z^2 - 1) / 6, rounded."""
    z = F.sqrt(-2.0 * F.log(u1 + F.lit(1e-12))) * F.cos(2 * 3.141592653589793 * u2)
    n = mean.cast("double")
    return F.greatest(F.lit(0.0), F.round(n + F.sqrt(n) * z + (z * z - 1) / 6))


def bootstrap_interval(df: DataFrame, by: str, flag: str, replicates: int = 200,
                       seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of a group mean of a 0/1 flag (A12, seaborn's bar interval).

    Poisson bootstrap on the (group, value) frequency table: a replicate draws
    Poisson(n) copies of each cell. The frequency table is tiny (2 cells per
    group), so the replicate expansion never touches raw rows. Draws invert the Poisson
    distribution function up to n = 400, and its Cornish-Fisher expansion (error under 0.01 of
    a count's sd) beyond. A replicate without copies of a group has no mean.
    """
    from tessera.functions.scalar import hash_uniform
    freq = df.where(F.col(flag).isNotNull()).groupBy(by, flag).agg(F.count(F.lit(1)).alias("n"))
    reps = freq.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # the uniforms are hashes of (group, value, replicate), so a recomputed task draws the same numbers
    u1 = hash_uniform(by, flag, "rep", seed=seed)
    u2 = hash_uniform(by, flag, "rep", seed=seed + 1)
    draw = F.when(F.col("n") <= POISSON_EXACT, poisson_draw(F.col("n"), u1)).otherwise(poisson_far(F.col("n"), u1, u2))
    reps = reps.withColumn("m", draw)
    means = (reps.groupBy(by, "rep")
             .agg(F.try_divide(F.sum(F.col(flag) * F.col("m")), F.sum("m")).alias("mean")))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return means.groupBy(by).agg(F.percentile("mean", [lo, hi]).alias("__q")).select(
        by, F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def adjacent_pairs(tokens: Column) -> Column:
    """[(t0,t1), (t1,t2), ...] of an array column."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<struct<first:string,second:string>>")).otherwise(
        F.arrays_zip(F.slice(tokens, 1, n - 1).alias("first"),
                     F.slice(tokens, 2, n - 1).alias("second")))


def pivot_wide(df: DataFrame, row: str, col: str, value: str, values: Sequence | None = None,
               fill=0) -> DataFrame:
    """Row x column sums, zero-filled (A7). Pass ``values`` to skip the distinct
    pass and bound the width; ``spark.sql.pivotMaxValues`` guards otherwise."""
    g = df.groupBy(row)
    p = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    out = p.agg(F.sum(value))
    return out.na.fill(fill) if fill is not None else out


def histogram(df: DataFrame, value: str, bins: int = 10, by: Sequence[str] | str | None = None) -> DataFrame:
    """Equal-width bin counts between the min and max (D1h), numpy's convention:
    the maximum falls in the last bin."""
    by = as_list(by)
    v = F.col(value).cast("double")
    rng = (df.groupBy(*by) if by else df).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    base = df.join(rng, by) if by else attach_scalars(df, rng)
    width = F.col("__hi") - F.col("__lo")
    raw = F.floor((v - F.col("__lo")) / width * F.lit(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), raw)).cast("long")
    counted = (base.where(v.isNotNull()).withColumn("bin", b)
               .groupBy(*by, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("n")))
    return counted.select(*by, "bin",
                          (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("low"),
                          (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("high"),
                          "n")


def kde(df: DataFrame, value: str, grid: int = 64) -> DataFrame:
    """Gaussian kernel density on ``grid`` points between min and max (D2h).

    Bandwidth: Scott's factor n^(-1/5) times the sample sd. Every value counts at every
    grid point: a task adds up its batches against the whole grid and passes on one row for each
    point. The density is NULL where the bandwidth is zero or unknown (constant column, single
    value); a column without values gives no rows.
    """
    v = F.col(value).cast("double")
    st = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"),
                F.max(v).alias("hi"))
    base = attach_scalars(df.where(v.isNotNull()).select(v.alias("v")), st)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, x = np.zeros(grid), None
        for b in parts:
            if not b.num_rows:
                continue
            if x is None:
                n, sd, lo, hi = (b.column(i)[0].as_py() for i in range(1, 5))
                x = lo + np.arange(grid) * ((hi - lo) / (grid - 1))
                h = (sd or 0.0) * n ** -0.2
            for i in range(0, b.num_rows if h else 0, 4096):
                z = (x - b.column(0).slice(i, 4096).to_numpy()[:, None]) / h
                total += np.exp(-0.5 * z * z).sum(0) / (n * h * 2.5066282746310002)
        if x is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(grid), pa.int32()), pa.array(x),
                                              pa.array(total if h else [None] * grid, pa.float64())], ["point", "x", "density"])

    sums = base.mapInArrow(run, "point int, x double, density double")
    return sums.groupBy("point", "x").agg(F.sum("density").alias("density"))


def box_summary(df: DataFrame, value: str, by: Sequence[str] | str | None = None,
                whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at ``whisker`` x IQR and the outlier count per group (D3h)."""
    from tessera.operators.rank import exact_quantiles, quartile_columns
    by = as_list(by)
    v = F.col(value).cast("double")
    q = quartile_columns(exact_quantiles(df, value, [0.25, 0.5, 0.75], by), by)
    base = df.join(counted_side(q), by) if by else attach_scalars(df, q)
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - whisker * iqr
    hi_f = F.col("q3") + whisker * iqr
    inside = (v >= lo_f) & (v <= hi_f)
    return (base.groupBy(*by, "q1", "median", "q3")
            .agg(F.min(F.when(inside, v)).alias("whisker_low"),
                 F.max(F.when(inside, v)).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers"),
                 F.count(v).alias("n")))


def regression_lines(df: DataFrame, x: str, y: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """Slope, intercept, R^2 and r of y on x per group (D4h, H1)."""
    by = as_list(by)
    aggs = [F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
            pair_corr(x, y).alias("r")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
