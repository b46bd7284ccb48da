"""Market-basket mining.

Baskets are item sets per basket key; frequent item sets come from Spark ML's
FPGrowth (a distributed FP-tree, never all item pairs); association rules
are grown from the frequent item sets — multi-item consequents included, which
``FPGrowthModel.associationRules`` omits — and each side is joined to the item-set
supports on a canonical string key.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators._util import attach_scalars
from tessera.session import materialize

SEP = "\u001f"


def baskets(df: DataFrame, basket: str, item: str, qty: str | None = None, min_qty: float = 1) -> DataFrame:
    """(basket, items): distinct items whose total quantity in the basket is at
    least ``min_qty`` (B3, X14). Baskets with no such item keep an empty array,
    so they stay in the support denominator like all-zero rows do in a 0/1 matrix."""
    if qty is None:
        per = df.groupBy(basket, item).agg(F.count(F.lit(1)).alias("__q"))
    else:
        per = df.groupBy(basket, item).agg(F.sum(qty).alias("__q"))
    keep = F.when(F.col("__q") >= F.lit(min_qty), F.col(item))
    return per.groupBy(basket).agg(F.sort_array(F.collect_set(keep)).alias("items"))


def item_key(items: Column) -> Column:
    """Canonical string key of an item set."""
    return F.array_join(F.array_sort(items), SEP)


def frequent_itemsets(bk: DataFrame, min_support: float, items: str = "items") -> DataFrame:
    """(items, freq, support, size, key) of item sets with support >= ``min_support``."""
    bk = materialize(bk)  # counted once, read twice by the mining
    n = bk.agg(F.count(F.lit(1)).alias("__n"))
    model = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=0.0).fit(bk)
    fi = model.freqItemsets.withColumn("items", F.array_sort("items"))
    return (attach_scalars(fi, n)
            .select("items", "freq", (F.col("freq") / F.col("__n")).alias("support"),
                    F.size("items").alias("size"), item_key(F.col("items")).alias("key")))


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float = 0.8) -> DataFrame:
    """Every rule A -> C with A, C non-empty, disjoint and A u C frequent (B5):
    support, confidence, lift, leverage, conviction (NULL when confidence is 1).

    Rules grow level by level: consequents of one item first, then one item more (after the last, in
    the order of the set). Confidence falls as a consequent takes items from the antecedent, so with
    ``metric="confidence"`` a rule under the threshold is not grown, and sets of any length cost what
    their strong rules do; the other metrics have no such order and look at every split. Both sides
    get their support by a join with the item sets.
    """
    sets = materialize(itemsets.select("items", "key", "support", "size"))
    largest = sets.agg(F.max("size")).first()[0] or 0
    lookup = sets.select("key", "support")
    level = sets.where(F.col("size") >= 2).select(
        "items", "support", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array(i))).alias("__c"))
    out = None
    for m in range(1, max(2, largest)):
        ante = F.filter("items", lambda x, i: ~F.array_contains("__c", i))
        cons = F.transform("__c", lambda i: F.get("items", i))
        found = level.select("items", "__c", ante.alias("antecedents"), cons.alias("consequents"), "support")
        found = (found.withColumn("__ka", item_key(F.col("antecedents"))).withColumn("__kc", item_key(F.col("consequents")))
                 .join(lookup.withColumnRenamed("key", "__ka").withColumnRenamed("support", "antecedent_support"), "__ka")
                 .join(lookup.withColumnRenamed("key", "__kc").withColumnRenamed("support", "consequent_support"), "__kc")
                 .drop("__ka", "__kc").withColumn("confidence", F.col("support") / F.col("antecedent_support")))
        if metric == "confidence":
            found = found.where(F.col("confidence") >= F.lit(min_threshold))
        if m + 1 < largest:
            found = materialize(found)
        out = found if out is None else out.unionByName(found)
        last = F.element_at("__c", -1)
        grown = found.where((F.size("items") > m + 1) & (last < F.size("items") - 1))
        level = grown.select("items", "support", F.explode(F.transform(
            F.sequence(last + 1, F.size("items") - 1), lambda i: F.concat("__c", F.array(i)))).alias("__c"))
        if m + 1 >= largest or not level.head(1):
            break
    out = (out.drop("items", "__c")
           .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
           .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
           .withColumn("conviction", F.when(F.col("confidence") < 1,
                                            (1 - F.col("consequent_support")) / (1 - F.col("confidence")))))
    return out.where(F.col(metric) >= F.lit(min_threshold))


def strong_rules(rules: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Rules with confidence above the cut, strongest first."""
    return (rules.where(F.col("confidence") > F.lit(min_confidence))
            .orderBy(F.desc("confidence"), item_key(F.col("antecedents")), item_key(F.col("consequents"))))


def rule_matrix(rules: DataFrame, value: str = "confidence", wide: bool = False) -> DataFrame:
    """Antecedent x consequent -> confidence (B7, A8). Long form by default; the
    wide pivot has one column per distinct consequent set."""
    long = rules.select(F.array_join("antecedents", ", ").alias("antecedent"),
                        F.array_join("consequents", ", ").alias("consequent"), F.col(value))
    if not wide:
        return long
    return long.groupBy("antecedent").pivot("consequent").agg(F.first(value))
