"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    The aggregate becomes an uncorrelated scalar subquery (one struct): Spark
    runs it once, before the main plan, and inlines the value — no join, no
    cross join, and the large side is never shuffled. ``scalars`` must hold
    exactly one row (a global aggregate always does).
    """
    cols = scalars.columns
    packed = scalars.select(F.struct(*[F.col(c) for c in cols]).alias("__scalars")).scalar()
    return df.withColumn("__scalars", packed).select(
        "*", *[F.col("__scalars")[c].alias(c) for c in cols]).drop("__scalars")


#: Rows of a table that is broadcast at most; larger ones are joined by a shuffle.
MAX_SMALL_ROWS = 100_000


def counted_side(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and broadcast where its counted rows prove it small.

    For the small side of a join with raw rows: one row per group or per few buckets. The raw rows
    are then not shuffled, whatever the session's own limit; a side that grew too large is joined by
    a shuffle as usual.
    """
    from tessera.session import materialize

    written = materialize(df)
    return F.broadcast(written) if written.count() <= MAX_SMALL_ROWS else written


#: Rows of a task where each row takes up much memory or time, as in a fit.
TASK_ROWS = 250_000


def spread(written: DataFrame) -> DataFrame:
    """``written`` (from ``materialize``) in parts of about ``TASK_ROWS`` rows. It is written again only
    where a part holds more, as a scan or join of compact columns leaves them."""
    from tessera.session import materialize

    held = written.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (held["most"] or 0) <= TASK_ROWS:
        return written
    return materialize(written.repartition(-(-held["rows"] // TASK_ROWS)))


def pair_corr(x: str, y: str) -> Column:
    """Pearson r of two columns over the rows where both are known; NULL where one of them is
    constant there."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sd = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), sd)


def unpivot_row(df: DataFrame, keep: Sequence[str], groups: dict[str, dict[str, Column]],
                label: str = "column") -> DataFrame:
    """Turn a wide aggregate into long form: one output row per entry of ``groups``.

    ``groups`` maps an output label to {field name: column expression}; every
    entry must produce the same fields. Uses ``inline(array(struct))`` — one
    generator, no join.
    """
    structs = []
    for name, fields in groups.items():
        structs.append(F.struct(F.lit(name).alias(label),
                                *[c.alias(f) for f, c in fields.items()]))
    return df.select(*keep, F.inline(F.array(*structs)))


def null_any(cols: Iterable[str]) -> Column:
    cond = None
    for c in cols:
        e = F.col(c).isNull()
        cond = e if cond is None else (cond | e)
    return cond if cond is not None else F.lit(False)
