"""Feature preparation (N1-N14): missing values, scaling, correlation, encodings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators._util import as_list, attach_scalars, counted_side, null_any, unpivot_row
from tessera.operators.profile import null_counts


def sparse_column_report(df: DataFrame, max_pct_null: float = 70.0,
                         cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: percent null and whether it is kept."""
    return (null_counts(df, cols)
            .withColumn("kept", F.col("pct_null") <= F.lit(max_pct_null)))


def drop_sparse_columns(df: DataFrame, max_pct_null: float = 70.0) -> DataFrame:
    """Drop columns with more than ``max_pct_null`` percent nulls.

    The decision needs one aggregate row (one value per column) on the driver;
    no data rows move there.
    """
    rep = sparse_column_report(df, max_pct_null).where(~F.col("kept")).select("column").collect()
    return df.drop(*[r["column"] for r in rep])


def drop_null_rows(df: DataFrame, how: str = "any", cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with any / all nulls removed."""
    return df.na.drop(how=how, subset=list(cols) if cols else None)


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean",
           by: Sequence[str] | str | None = None) -> DataFrame:
    """Replace nulls by the column mean or exact median.

    The statistics are one aggregate row (or one row per group) attached by a
    join; the exact medians come from the distributed rank machinery (ML's
    ``Imputer`` median is approximate).
    """
    by = as_list(by)
    if strategy == "mean":
        stats = [F.avg(c).alias(f"__fill_{i}") for i, c in enumerate(cols)]
        st = df.groupBy(*by).agg(*stats) if by else df.agg(*stats)
    elif strategy == "median":
        from tessera.operators.rank import column_quantiles
        q = column_quantiles(df, cols, [0.5], by)
        st = q.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"__fill_{i}")
                                  for i, c in enumerate(cols)]) if by else \
            q.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"__fill_{i}") for i, c in enumerate(cols)])
    else:
        raise ValueError(strategy)
    base = df.join(counted_side(st), by, "left") if by else attach_scalars(df, st)
    # like pandas, a column that had missing values becomes floating point
    for i, c in enumerate(cols):
        base = base.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"__fill_{i}").cast("double")))
    return base.drop(*[f"__fill_{i}" for i in range(len(cols))])


def missing_policy(df: DataFrame, cols: Sequence[str] | None = None,
                   max_share: float = 0.20) -> tuple[str, DataFrame]:
    """The cleaning branch of the feature-ranking driver (N6, defects D5, D6).

    share of rows with a null == 0 -> keep; <= ``max_share`` -> drop those rows;
    above -> drop all-null rows and mean-impute. Returns (policy, frame).
    """
    cols = list(cols or df.columns)
    share = df.agg(F.avg(null_any(cols).cast("double")).alias("s")).first()["s"] or 0.0
    if share == 0:
        return "keep", df
    if share <= max_share:
        return "drop_rows", df.na.drop(how="any", subset=cols)
    return "impute_mean", impute(df.na.drop(how="all", subset=cols), cols, "mean")


def column_sd(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample standard deviation per column, long form (one pass)."""
    wide = df.agg(*[F.stddev_samp(c).alias(f"__sd{i}") for i, c in enumerate(cols)])
    return unpivot_row(wide, [], {c: {"sd": F.col(f"__sd{i}")} for i, c in enumerate(cols)})


def variance_report(df: DataFrame, cols: Sequence[str], min_sd: float = 0.2) -> DataFrame:
    """Low-variance filter decisions: keep a feature when its sample sd >= ``min_sd``.
    The response is never filtered (defect D10)."""
    return column_sd(df, cols).withColumn("kept", F.col("sd") >= F.lit(min_sd))


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population sd, like scikit-learn's StandardScaler."""
    st = df.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(cols)])
    out = attach_scalars(df, st)
    for i, c in enumerate(cols):
        sd = F.col(f"__s{i}")
        z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__m{i}")) / sd)
        out = out.withColumn(c + suffix, z)
    return out.drop(*[f"__m{i}" for i in range(len(cols))], *[f"__s{i}" for i in range(len(cols))])


def minmax_scale(df: DataFrame, score: str, order: int = 1, digits: int | None = 3,
                 name: str = "scaled") -> DataFrame:
    """Scale ``order * score`` to [0, 1] over the frame, then round."""
    s = F.col(score) * F.lit(order)
    st = df.agg(F.min(s).alias("__lo"), F.max(s).alias("__hi"))
    rng = F.col("__hi") - F.col("__lo")
    v = F.when(rng == 0, F.lit(0.0)).otherwise((s - F.col("__lo")) / rng)
    if digits is not None:
        v = F.round(v, digits)
    return attach_scalars(df, st).withColumn(name, v).drop("__lo", "__hi")


#: Rows of the moment matrix that travel together.
BLOCK_ROWS = 64
#: Rows whose means become the origin of the moments.
PIVOT_ROWS = 1000


def corr_pairs(df: DataFrame, cols: Sequence[str], absolute: bool = True,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pearson correlation of every pair i < j, long form (N11), over the rows where both
    are known (neither NULL nor NaN); NULL where there are none or one of them is constant there.

    One scan for any number of columns: every task multiplies its batches into the moment matrix
    of the columns and their masks of known values (counts, sums, squares and products by pair), and
    blocks of the matrix's rows are summed across tasks and turned into correlations where they
    meet (``block_rows`` rows of the matrix travel together). Moments are taken about the means of a few rows, so columns far from zero keep their
    digits.
    """
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("two columns are needed")
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    known = x.limit(PIVOT_ROWS).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in x.columns]).first()
    pivot = np.array([v if v is not None else 0.0 for v in known])
    blocks = x.mapInArrow(_moment_blocks(pivot, block_rows), "block int, moments binary")
    pairs = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(
        _block_correlations(cols, absolute, block_rows), "feature_a string, feature_b string, r double")
    return pairs


def _moment_blocks(pivot: np.ndarray, size: int):
    """Moments of a task's rows. With x the values less their pivot, 0 where unknown, and m the
    mask: for each pair the products x x', and m m', x m', m x', x^2 m', m x^2'."""
    d = len(pivot)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for b in parts:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - pivot  # NULL comes as NaN
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            xm, sm = x.T @ m, (x * x).T @ m
            total += np.stack([x.T @ x, m.T @ m, xm, xm.T, sm, sm.T])
        starts = range(0, d, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // size for i in starts], pa.int32()),
             pa.array([np.ascontiguousarray(total[:, i:i + size]).tobytes() for i in starts], pa.binary())], ["block", "moments"])

    return run


def _block_correlations(cols: list[str], absolute: bool, size: int):
    """Correlations from blocks of moments that come block by block; one block is held."""
    d = len(cols)

    def rows(block: int, total: np.ndarray) -> pa.RecordBatch:
        xx, n, xi, xj, si, sj = total
        with np.errstate(divide="ignore", invalid="ignore"):
            mi, mj = xi / n, xj / n
            vi, vj = si / n - mi * mi, sj / n - mj * mj
            r = (xx / n - mi * mj) / np.sqrt(vi * vj)
            constant = (vi <= 1e-12 * si / n) | (vj <= 1e-12 * sj / n)
        first = block * size
        i, j = np.nonzero(np.arange(first, first + total.shape[1])[:, None] < np.arange(d))
        r = np.clip(r[i, j], -1.0, 1.0)
        unknown = constant[i, j] | ~np.isfinite(r)
        return pa.RecordBatch.from_arrays(
            [pa.array([cols[first + k] for k in i], pa.string()), pa.array([cols[k] for k in j], pa.string()),
             pa.array(np.abs(r) if absolute else r, mask=unknown)], ["feature_a", "feature_b", "r"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in parts:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                moments = np.frombuffer(data.as_buffer(), float).reshape(6, -1, d)
                if block != at:
                    if at is not None:
                        yield rows(at, total)
                    at, total = block, np.zeros_like(moments)
                total += moments
        if at is not None:
            yield rows(at, total)

    return run


def collinear_flag(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Max abs(r) over all pairs and whether it reaches ``threshold``."""
    return (pairs.agg(F.max(F.abs("r")).alias("max_abs_r"))
            .withColumn("collinear", F.col("max_abs_r") >= F.lit(threshold)))


def one_hot_columns(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Wide 0/1 columns for every level, all levels kept (N8, pandas get_dummies)."""
    prefix = prefix or col
    out = df
    for lv in levels:
        out = out.withColumn(f"{prefix}_{lv}", (F.col(col) == F.lit(lv)).cast("int"))
    return out


#: Levels that a column may have to be one-hot encoded in wide form.
MAX_LEVELS = 10_000


def levels_of(df: DataFrame, col: str, limit: int = MAX_LEVELS) -> list:
    """Sorted distinct values of a categorical column; an error where there are more than ``limit``
    (each would be a column)."""
    rows = df.select(col).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} levels")
    return sorted((r[0] for r in rows), key=lambda v: (v is not None, v))


def sum_contrasts(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Sum-to-zero contrast columns, k-1 of them: level i -> 1, last level -> -1."""
    prefix = prefix or col
    last = levels[-1]
    out = df
    for i, lv in enumerate(levels[:-1], start=1):
        out = out.withColumn(f"{prefix}{i}", F.when(F.col(col) == lv, 1)
                             .when(F.col(col) == last, -1).otherwise(0))
    return out


def ml_one_hot(cols: Sequence[str]):
    """Stages of an ML pipeline that index and one-hot encode ``cols`` with all
    levels kept and unseen levels tolerated (N8, defect D11)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__vec" for c in cols],
                        dropLast=False, handleInvalid="keep")
    return [idx, ohe], [f"{c}__vec" for c in cols]
