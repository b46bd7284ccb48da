"""Stand-in tables derived from the shared test data.

The source analyses read files that are not available (a web A/B log, a wide
regression table, bookseller CSVs, loans, a height/weight table, sales). Each
function below derives a table of the same shape from the shared parquet
tables, so every query grows with the data it reads. The same derivations are
written in SQL in ``tessera.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import load

# Variant labels of the A/B experiment, in order of user_id % 3.
VARIANTS = ("control", "bottom", "top_and_bottom")
# The raw loan statuses of the loans table and their grouping.
DEFAULT_STATUSES = ("Charged Off", "Late (31-120 days)", "Default",
                    "Does not meet the credit policy. Status:Charged Off")
PAID_STATUSES = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
# The six part types used as book genres.
GENRES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B visits: one row per (user, day, device) with zero-filled counts."""
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    out = (ev.withColumn("date", F.to_date("ts"))
           .withColumn("device_type", F.when(F.col("event_id") % 2 == 0, "mobile").otherwise("desktop"))
           .groupBy("user_id", "date", "device_type")
           .agg(F.min("event_id").alias("visit_id"),
                F.count(F.lit(1)).alias("total_pageviews"),
                F.count_if(et == "purchase").alias("shopping_pageviews"),
                F.count_if(et == "click").alias("ad_clicks"),
                F.count_if(et == "signup").alias("shares"),
                F.count_if(et == "view").alias("bottom_of_page_reached"),
                F.count_if((et == "click") & (F.col("value") >= 25)).alias("bottom_related_link_clicks"),
                F.count_if(et == "error").alias("top_related_link_clicks")))
    variant = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.col("user_id") % 3 + 1).cast("int"))
    return out.withColumn("variant", variant)


def visits_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits table as the NDJSON source delivers it: every field a string,
    dates as yyyyMMdd (input of the type-coercion step)."""
    v = visits(spark, sf_dir)
    cols = [F.col(c).cast("string").alias(c) for c in v.columns if c != "date"]
    return v.select(*cols, F.date_format("date", "yyyyMMdd").alias("date"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan applications: orders joined to customers and nations, with text
    fields, skewed amounts and injected nulls."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_totalprice", "o_orderdate", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: a broadcast of bounded size
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    status = (F.when(F.col("o_orderstatus") == "F", "Fully Paid")
              .when(F.col("o_orderstatus") == "O", "Charged Off")
              .when(F.col("o_orderpriority") == "1-URGENT", "Default")
              .when(F.col("o_orderpriority") == "2-HIGH", "Late (31-120 days)")
              .otherwise("Current"))
    nk = F.col("c_nationkey")
    emp = (F.when(nk == 0, "< 1 year").when(nk >= 10, "10+ years").when(nk == 7, F.lit(None))
           .otherwise(F.concat(nk.cast("string"), F.lit(" years"))))
    key = F.col("o_orderkey")
    return j.select(
        key.alias("id"), status.alias("loan_status"), emp.alias("emp_length"),
        F.col("o_orderpriority").alias("purpose"), F.col("n_name").alias("addr_state"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.col("o_orderstatus").alias("verification_status"),
        F.when(key % 17 == 0, F.lit(None)).otherwise(F.col("c_acctbal") + 1000.0).alias("annual_inc"),
        (F.col("o_totalprice") / 20000.0).alias("dti"),
        F.col("o_totalprice").alias("revol_bal"),
        F.when(key % 5 == 0, nk).alias("mths_since_last_major_derog"),
        F.when(key % 4 == 0, F.col("o_orderstatus")).alias("verification_status_joint"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("apply_date"),
        F.concat(F.lit("1/1/"), (F.year("o_orderdate") - nk - 1).cast("string")).alias("earliest_cr_line"))


def dogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height / weight / gender rows from line items."""
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.col("l_quantity").alias("height"),
                     (F.col("l_extendedprice") / 1000.0).alias("weight"),
                     F.when(F.col("l_linestatus") == "F", "male").otherwise("female").alias("gender"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines: member (customer), product (part) and quantity."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("member_id"), F.col("l_partkey").alias("product_id"),
                    F.col("l_quantity").alias("quantity")))


def product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines without the member: product-level questions need no join to orders."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"),
                                              F.col("p_name").alias("product_name"))


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookseller customers with a list-literal string of favourite genres."""
    c = load(spark, sf_dir, "customer")
    g = F.array(*[F.lit(x) for x in GENRES])
    a = F.element_at(g, (F.col("c_custkey") % 6 + 1).cast("int"))
    b = F.element_at(g, (F.col("c_nationkey") % 6 + 1).cast("int"))
    fav = (F.when(F.col("c_custkey") % 10 == 0, F.lit("[]"))
           .otherwise(F.concat(F.lit('["'), a, F.lit('", \''), b, F.lit("']"))))
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("age_bucket"),
                    (F.col("c_acctbal") > 0).cast("string").alias("is_returning_customer"),
                    fav.alias("favorite_genres"))


def product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("genre"),
                    F.col("p_size").cast("double").alias("length"), F.col("p_brand").alias("difficulty"),
                    (F.col("p_size") % 2 == 0).cast("string").alias("fiction"))


def assortment(spark: SparkSession, sf_dir: str, month: str) -> DataFrame:
    """(customer, product) offers. ``month='last'``: finished orders with the
    observed purchase flag; ``'next'``: open orders, to be scored."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = "F" if month == "last" else "O"
    j = li.join(o.where(F.col("o_orderstatus") == status), li.l_orderkey == o.o_orderkey)
    cols = [F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id")]
    if month == "last":
        cols.append((F.col("l_returnflag") != "R").cast("int").alias("purchased"))
    return j.select(*cols)


def purchase_order(spark: SparkSession, sf_dir: str, month: str) -> DataFrame:
    """Per product: quantity bought for the month's assortment, unit cost and retail value."""
    a = assortment(spark, sf_dir, month).groupBy("product_id").agg(F.count(F.lit(1)).alias("quantity_purchased"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (a.join(p, a.product_id == p.p_partkey)
            .select("product_id", "quantity_purchased",
                    (F.col("p_retailprice") / 1000.0 * 0.6).alias("cost_to_buy"),
                    (F.col("p_retailprice") / 1000.0).alias("retail_value")))


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nulls injected by key (the shared tables have none)."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_returnflag")
