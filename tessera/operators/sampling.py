"""Reproducible sampling, splitting and class balancing.

Randomness comes from hashing a row key with a seed, never from partition
layout, so results do not change when the input is re-partitioned or a task
is retried after an executor loss. Exact per-class counts use the distributed
rank machinery of ``tessera.operators.rank`` instead of a window over a whole
class (a class may hold a third of all rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators._util import as_list, counted_side
from tessera.operators.rank import bucket_splits, cumulative_counts

_M = 1000003  # a prime modulus for the portable affine hash


def unit_hash(key: Sequence[str] | str, seed: int = 42, method: str = "xxhash64") -> Column:
    """A number in [0, 1) derived from the key columns and the seed.

    ``xxhash64`` (default) mixes well; ``affine`` — ((k mod p) * 7919 + seed) mod p / p on
    a single non-negative integer key — is plain integer arithmetic that any SQL
    engine reproduces, used where results are cross-checked in SQL.
    """
    key = as_list(key)
    if method == "affine":
        k = F.col(key[0]).cast("long")
        return ((F.pmod(k, F.lit(_M)) * 7919 + seed) % _M) / float(_M)
    h = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)) / float(1 << 30)


def order_hash(key: Sequence[str] | str, seed: int = 42, method: str = "xxhash64") -> Column:
    """The whole number by which rows are put in random order; see ``unit_hash`` for the methods."""
    key = as_list(key)
    if method == "affine":
        return (F.pmod(F.col(key[0]).cast("long"), F.lit(_M)) * 7919 + seed) % _M
    return F.xxhash64(*[F.col(c) for c in key], F.lit(seed))


def hash_split(df: DataFrame, key: Sequence[str] | str, test_fraction: float = 0.25, seed: int = 42,
               method: str = "xxhash64", col: str = "split") -> DataFrame:
    """Label each row 'train' or 'test' (R1); deterministic per key."""
    u = unit_hash(key, seed, method)
    return df.withColumn(col, F.when(u < F.lit(test_fraction), "test").otherwise("train"))


def class_ranks(df: DataFrame, label: str, key: Sequence[str] | str, seed: int = 42,
                n_buckets: int = 128, out: str = "class_rank") -> DataFrame:
    """Dense 1-based rank of each row within its class in hash order, plus the
    class size ``class_n``. Hash values are (near) unique, so ties are broken
    by the key itself."""
    key = as_list(key)
    u = unit_hash(key, seed)
    base = df.withColumn("__u", u)
    order = F.struct(F.col("__u"), *[F.col(c) for c in key])
    ties = base.groupBy(label, "__u").agg(F.count(F.lit(1)).alias("__t"))
    cum = cumulative_counts(ties, [label], "__u", "__t", n_buckets, out="__below", bounds=(base, "__u"))
    sizes = ties.groupBy(label).agg(F.sum("__t").alias("class_n"))
    ranked = base.join(cum.select(label, "__u", "__below"), [label, "__u"]).join(sizes, label)
    from pyspark.sql import Window
    # rows sharing a hash value (collisions) get consecutive ranks; the window
    # partition is one hash value, i.e. one or very few rows
    w = Window.partitionBy(label, "__u").orderBy(order)
    return ranked.withColumn(out, F.col("__below") + F.row_number().over(w)).drop("__u", "__below")


def select_first_per_class(df: DataFrame, label: str, key: Sequence[str] | str, keep: Column,
                           seed: int = 42, col: str = "__selected", n_buckets: int = 128,
                           method: str = "xxhash64") -> DataFrame:
    """Flag the first ``keep`` rows of each class in hash order (``keep`` is an
    expression over ``label`` and ``class_n``, the class size), exactly, without
    ranking every row.

    Rows are counted per (class, ordered hash bucket); running offsets find the
    one bucket per class where the cut falls; only that bucket's rows are
    ordered (hash, then key) to place the cut. Every other row is decided by
    comparing its bucket with the cut bucket. The cuts are one row per class, written and
    counted, so a class that holds most rows is not shuffled by its label. Rows without a label
    form a class of their own.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    from tessera.session import materialize

    key = as_list(key)
    base = df.withColumn("__h", order_hash(key, seed, method)).withColumn("__hd", F.col("__h").cast("double"))
    splits = bucket_splits(base, "__hd", n_buckets)
    bk = Bucketizer(splits=splits, inputCol="__hd", outputCol="__b", handleInvalid="keep").transform(base)
    cnt = bk.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w_run = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = (cnt.withColumn("__off", F.coalesce(F.sum("__c").over(w_run), F.lit(0)))
           .withColumn("class_n", F.sum("__c").over(Window.partitionBy(label)))
           .withColumn("__keep", keep.cast("long")))
    cnt = materialize(cnt)
    # per class: the bucket holding the cut (or none when the class keeps all / nothing)
    cut = (cnt.where((F.col("__off") < F.col("__keep")) & (F.col("__keep") <= F.col("__off") + F.col("__c")))
           .select(label, F.col("__b").alias("__cut_b"), (F.col("__keep") - F.col("__off")).alias("__need")))
    info = cnt.groupBy(label).agg(F.first("class_n").alias("class_n"), F.first("__keep").alias("__keep"))
    info = info.alias("i").join(cut.alias("c"), F.col(f"i.{label}").eqNullSafe(F.col(f"c.{label}")), "left").select(
        F.col(f"i.{label}").alias("__label"), "class_n", "__keep", "__cut_b", "__need")
    rows = bk.join(counted_side(info), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    inside = F.col("__cut_b").isNotNull() & (F.col("__b") == F.col("__cut_b"))
    outside = rows.where(~inside | F.col("__cut_b").isNull()).withColumn(
        col, F.when(F.col("__cut_b").isNull(), F.col("__keep") >= F.col("class_n"))
        .otherwise(F.col("__b") < F.col("__cut_b")))
    w_cut = Window.partitionBy(label).orderBy("__h", *key)
    at_cut = rows.where(inside).withColumn(col, F.row_number().over(w_cut) <= F.col("__need"))
    return (outside.unionByName(at_cut)
            .drop("__h", "__hd", "__b", "__cut_b", "__need", "__keep"))


def stratified_split(df: DataFrame, label: str, key: Sequence[str] | str, test_fraction: float = 0.2,
                     seed: int = 42, exact: bool = True, col: str = "split", method: str = "xxhash64") -> DataFrame:
    """Split keeping class shares (R2). ``exact``: exactly round(n_c * (1 - f))
    training rows per class, as scikit-learn; otherwise a per-row hash threshold."""
    if not exact:
        return hash_split(df, key, test_fraction, seed, method, col)
    n_train = F.round(F.col("class_n") * (1 - test_fraction))
    sel = select_first_per_class(df, label, key, n_train, seed, method=method)
    return (sel.withColumn(col, F.when(F.col("__selected"), "train").otherwise("test"))
            .drop("__selected", "class_n"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str] | str, k: int = 5, seed: int = 42,
                     col: str = "fold", n_buckets: int = 128, method: str = "xxhash64") -> DataFrame:
    """Assign folds 0..k-1 within each class (R3): in hash order, contiguous
    blocks of sizes n // k + (f < n % k), so fold sizes per class differ by at
    most one.

    Like the split, it only orders the rows of the (at most k - 1) buckets per
    class that contain a fold boundary; every other row takes the fold of its
    bucket.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    key = as_list(key)
    base = df.withColumn("__h", order_hash(key, seed, method)).withColumn("__hd", F.col("__h").cast("double"))
    splits = bucket_splits(base, "__hd", n_buckets)
    bk = Bucketizer(splits=splits, inputCol="__hd", outputCol="__b", handleInvalid="keep").transform(base)
    cnt = bk.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w_run = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("__c").over(Window.partitionBy(label))
    cnt = cnt.withColumn("__off", F.coalesce(F.sum("__c").over(w_run), F.lit(0))).withColumn("__n", n)
    # fold f starts after cut_f = f * (n // k) + min(f, n % k) rows, f = 1..k-1
    cuts = F.array(*[F.lit(f) * F.floor(F.col("__n") / k) + F.least(F.lit(f), F.col("__n") % k)
                     for f in range(1, k)]) if k > 1 else F.array().cast("array<long>")
    cnt = (cnt.withColumn("__cuts", cuts)
           .withColumn("__bfold", F.size(F.filter("__cuts", lambda x: x <= F.col("__off"))))
           .withColumn("__split", F.exists("__cuts", lambda x: (F.col("__off") < x) & (x < F.col("__off") + F.col("__c"))))
           .drop("__c", "__n"))
    # a row for each class and bucket, so the rows of a class are not shuffled by it
    cnt = counted_side(cnt.withColumnRenamed(label, "__label").withColumnRenamed("__b", "__cb"))
    rows = bk.join(cnt, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__cb"))).drop("__label", "__cb")
    whole = rows.where(~F.col("__split")).withColumn(col, F.col("__bfold").cast("int"))
    w_b = Window.partitionBy(label, "__b").orderBy("__h", *key)
    rank = F.col("__off") + F.row_number().over(w_b)
    cut = (rows.where(F.col("__split")).withColumn("__rank", rank)
           .withColumn(col, F.size(F.filter("__cuts", lambda x: x < F.col("__rank"))).cast("int"))
           .drop("__rank"))
    return whole.unionByName(cut).drop("__h", "__hd", "__b", "__off", "__cuts", "__bfold", "__split")


def undersample(df: DataFrame, label: str, key: Sequence[str] | str, seed: int = 42,
                method: str = "xxhash64") -> DataFrame:
    """Every class cut to the size of the smallest class, without replacement,
    exact counts (R4)."""
    # the smallest class size: one number per class reaches the driver
    n_min = min(r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect())
    sel = select_first_per_class(df, label, key, F.lit(n_min), seed, method=method)
    return sel.where(F.col("__selected")).drop("__selected", "class_n")


#: Rows of a class that are numbered together.
NUMBER_ROWS = 100_000


def oversample(df: DataFrame, label: str, key: Sequence[str] | str, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """Every smaller class drawn with replacement up to the largest class size.

    Only the rows of smaller classes move: hash buckets of about ``NUMBER_ROWS`` rows are numbered
    apart, and a bucket's numbers begin where those before it end (a count per bucket). Draws
    are generated in Spark (``range`` over their number), each hashed to a number of its class;
    draws per number are counted, and the numbered rows replicated with ``explode(sequence(1,
    copies))``. Results do not depend on partitions. Rows without a label are left out.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    from tessera.session import materialize

    key = as_list(key)
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull())
    sizes = {row[0]: row["n"] for row in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one a class
    n_max = max(sizes.values(), default=0)
    out = known.where(F.col(label).isin([c for c, n in sizes.items() if n == n_max]))
    for cls, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if n == n_max:
            continue
        many = -(-n // NUMBER_ROWS)
        rows = known.where(F.col(label) == F.lit(cls)).withColumn("__h", order_hash(key, seed, method))
        rows = materialize(rows.withColumn("__b", F.pmod(F.xxhash64("__h", *key), F.lit(many)) if many > 1 else F.lit(0).cast("long")))
        counts = {r["__b"]: r["n"] for r in rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}  # n / NUMBER_ROWS rows
        before, begins = 0, []
        for b in range(many):
            begins.append(before)
            before += counts.get(b, 0)
        within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key)) - 1
        rows = rows.withColumn("__within", within.cast("long")).drop("__h")
        if method == "affine":
            draw = F.pmod((F.pmod(F.col("id"), F.lit(_M)) * 7919 + seed) % _M, F.lit(n))
        else:
            draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(str(cls))), F.lit(n))
        draws = spark.range(n_max).select(draw.alias("__at")).groupBy("__at").agg(F.count(F.lit(1)).alias("__copies"))
        if many > 1:
            # buckets without rows begin where the next one does: a row goes to the last that begins there
            place = sorted({x: b for b, x in enumerate(begins)}.items())
            splits = [float(x) for x, _ in place] + [float("inf")]
            draws = Bucketizer(splits=splits, inputCol="__at", outputCol="__i").transform(draws.withColumn("__at", F.col("__at").cast("double")))
            at = F.col("__i").cast("int")
            draws = draws.select(F.get(F.array(*[F.lit(b).cast("long") for _, b in place]), at).alias("__b"), (
                F.col("__at").cast("long") - F.get(F.array(*[F.lit(x).cast("long") for x, _ in place]), at)).alias("__within"), "__copies")
        else:
            draws = draws.select(F.lit(0).cast("long").alias("__b"), F.col("__at").alias("__within"), "__copies")
        rep = rows.join(draws, ["__b", "__within"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        out = out.unionByName(rep.drop("__b", "__within", "__copies", "__copy"))
    return out


def replicate_splits(df: DataFrame, key: Sequence[str] | str, replicates: int = 10,
                     test_fraction: float = 0.1, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """Repeated random hold-out (R7): each row appears once per replicate with
    its own split label; replicate r uses seed + r."""
    key = as_list(key)
    rep = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    if method == "affine":
        k = F.col(key[0]).cast("long")
        u = ((F.pmod(k, F.lit(_M)) * 7919 + seed + F.col("replicate") * 104729) % _M) / float(_M)
    else:
        u = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed), F.col("replicate")), F.lit(1 << 30)) / float(1 << 30)
    return rep.withColumn("split", F.when(u < F.lit(test_fraction), "test").otherwise("train"))
