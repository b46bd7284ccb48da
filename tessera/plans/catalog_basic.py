"""Named queries: sources, profiles, projections, joins, aggregates, windows,
sorting, scalar functions and feature preparation.

Every query reads the shared tables (or stand-ins Spark derives from them)
and has a DuckDB twin in ``sql=``. Doubles are rounded on both sides to the
digits their magnitude allows, so floating summation order cannot change a
value hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import prep, profile, summary
from tessera.plans import sqlparts as Q
from tessera.plans.registry import query
from tessera.sources import standins as S
from tessera.sources.tables import load

# Product names whose totals the sales study reports.
NAMED_PRODUCTS = ("small ring", "red widget", "blue bolt")


def _sales_totals(spark, sf):
    # aggregate to one row per product before joining the catalogue: the join
    # then sees at most |products| rows per side instead of every sale
    tot = S.product_sales(spark, sf).groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    return tot.join(S.products(spark, sf), "product_id")


@query("top_products", "J1 A2 T1", sql="WITH " + Q.PRODUCT_SALES.strip() + """
SELECT t.product_id, p.product_name, t.quantity
FROM (SELECT product_id, sum(quantity) AS quantity FROM product_sales GROUP BY product_id) t
JOIN product p USING (product_id)
ORDER BY quantity DESC, product_id LIMIT 10""")
def top_products(spark: SparkSession, sf: str) -> DataFrame:
    return _sales_totals(spark, sf).orderBy(F.desc("quantity"), "product_id").limit(10) \
        .select("product_id", "product_name", "quantity")


@query("bottom_products", "J1 A2 T2", sql="WITH " + Q.PRODUCT_SALES.strip() + """
SELECT * FROM (
  SELECT t.product_id, p.product_name, t.quantity
  FROM (SELECT product_id, sum(quantity) AS quantity FROM product_sales GROUP BY product_id) t
  JOIN product p USING (product_id)
  ORDER BY quantity, product_id LIMIT 10)
ORDER BY quantity DESC, product_id""")
def bottom_products(spark, sf):
    low = _sales_totals(spark, sf).orderBy("quantity", "product_id").limit(10)
    return low.orderBy(F.desc("quantity"), "product_id").select("product_id", "product_name", "quantity")


@query("catalog_coverage", "P6", sql="WITH " + Q.PRODUCT_SALES.strip() + """
SELECT n_used, n_catalogue, round(n_used * 100.0 / n_catalogue, 6) AS pct_used FROM
 (SELECT count(DISTINCT s.product_id) AS n_used FROM product_sales s SEMI JOIN product p USING (product_id)),
 (SELECT count(DISTINCT product_id) AS n_catalogue FROM product)""")
def catalog_coverage(spark, sf):
    p = S.products(spark, sf)
    used = S.product_sales(spark, sf).select("product_id").join(p.select("product_id"), "product_id", "left_semi")
    return profile.coverage(used, p, "product_id").withColumn("pct_used", F.round("pct_used", 6))


@query("buyer_quantity_buckets", "A6 X13 A9", sql="WITH " + Q.SALES.strip() + """,
per_member AS (SELECT member_id, sum(quantity) AS quantity FROM sales GROUP BY member_id),
per_q AS (SELECT quantity, count(*) AS n_members FROM per_member GROUP BY quantity),
lab AS (SELECT CASE WHEN quantity >= 10 THEN '>=10' ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS label,
               CAST(sum(n_members) AS BIGINT) AS n_members FROM per_q GROUP BY 1)
SELECT label, n_members, round(n_members * 100.0 / sum(n_members) OVER (), 6) AS pct FROM lab""")
def buyer_quantity_buckets(spark, sf):
    per_member = S.sales(spark, sf).groupBy("member_id").agg(F.sum("quantity").alias("quantity"))
    per_q = per_member.groupBy("quantity").agg(F.count(F.lit(1)).alias("n_members"))
    lab = (per_q.withColumn("label", X.count_bucket("quantity"))
           .groupBy("label").agg(F.sum("n_members").alias("n_members")))
    return summary.with_share(lab, "n_members").withColumn("pct", F.round("pct", 6))


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("member_item_pivot", "A7 X17", sql="""
SELECT user_id, """ + ", ".join(
    f"round(coalesce(sum(CASE WHEN event_type = '{e}' THEN value END), 0), 4) AS {e}" for e in _EVENT_TYPES) + """
FROM events GROUP BY user_id""")
def member_item_pivot(spark, sf):
    ev = load(spark, sf, "events")
    wide = summary.pivot_wide(ev, "user_id", "event_type", "value", values=_EVENT_TYPES, fill=0.0)
    return wide.select("user_id", *[F.round(e, 4).alias(e) for e in _EVENT_TYPES])


@query("named_item_totals", "B8 A1 F4", sql="WITH " + Q.PRODUCT_SALES.strip() + """
SELECT product_name, sum(quantity) AS quantity
FROM product_sales JOIN product USING (product_id)
WHERE product_name IN ('small ring', 'red widget', 'blue bolt') GROUP BY product_name""")
def named_item_totals(spark, sf):
    p = S.products(spark, sf).where(F.col("product_name").isin(list(NAMED_PRODUCTS)))
    return (S.product_sales(spark, sf).join(p, "product_id")
            .groupBy("product_name").agg(F.sum("quantity").alias("quantity")))


_NULL_COLS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")


@query("null_profile", "P2 P3", sql="WITH " + Q.LINEITEM_NULLS.strip() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_null FROM li_nulls" for c in _NULL_COLS))
def null_profile(spark, sf):
    out = profile.null_counts(S.lineitem_with_nulls(spark, sf), _NULL_COLS)
    return out.select("column", "n_rows", "n_null", F.round("pct_null", 6).alias("pct_null"))


@query("row_null_share", "P4", sql="WITH " + Q.LINEITEM_NULLS.strip() + """
SELECT count(*) AS n_rows,
       CAST(count_if(l_discount IS NULL OR l_tax IS NULL OR l_extendedprice IS NULL) AS BIGINT) AS n_rows_with_null,
       round(avg(CASE WHEN l_discount IS NULL OR l_tax IS NULL OR l_extendedprice IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6)
         AS pct_rows_with_null
FROM li_nulls""")
def row_null_share(spark, sf):
    out = profile.any_null_share(S.lineitem_with_nulls(spark, sf), ["l_discount", "l_tax", "l_extendedprice"])
    return out.withColumn("pct_rows_with_null", F.round("pct_rows_with_null", 6))


_LOAN_COLS = ("emp_length", "annual_inc", "mths_since_last_major_derog", "verification_status_joint", "dti")


@query("drop_sparse_columns", "N1 P3", sql="WITH " + Q.LOANS.strip() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_null, "
    f"(count(*) - count({c})) * 100.0 / count(*) <= 70 AS kept FROM loans" for c in _LOAN_COLS))
def drop_sparse_columns(spark, sf):
    rep = prep.sparse_column_report(S.loans(spark, sf), 70.0, _LOAN_COLS)
    return rep.select("column", F.round("pct_null", 6).alias("pct_null"), "kept")


_ORDER_TYPES = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))


@query("table_overview", "P1 F7", sql="\nUNION ALL\n".join(
    f"SELECT (SELECT count(*) FROM orders) AS n_rows, '{c.replace('o_', 'order_')}' AS \"column\", "
    f"{i} AS position, '{t}' AS dtype" for i, (c, t) in enumerate(_ORDER_TYPES)))
def table_overview(spark, sf):
    o = load(spark, sf, "orders")
    renamed = o.withColumnsRenamed({c: c.replace("o_", "order_") for c in o.columns})
    return profile.overview(renamed)


@query("key_check", "P5", sql="""
SELECT 'o_orderkey' AS key, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct,
       count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
UNION ALL
SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders""")
def key_check(spark, sf):
    o = load(spark, sf, "orders")
    a = profile.key_check(o, "o_orderkey").select(F.lit("o_orderkey").alias("key"), "*")
    b = profile.key_check(o, "o_custkey").select(F.lit("o_custkey").alias("key"), "*")
    return a.unionByName(b)


@query("value_shares", "P7 P8", sql="""
SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_total,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders GROUP BY o_orderpriority""")
def value_shares(spark, sf):
    out = profile.value_counts(load(spark, sf, "orders"), "o_orderpriority", normalize=True)
    return out.select("o_orderpriority", "n", F.col("n_total").cast("long").alias("n_total"),
                      F.round("share", 6).alias("share"))


_DESC_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _desc_sql(by: str | None) -> str:
    parts = []
    for c in _DESC_COLS:
        g = f"{by}, " if by else ""
        parts.append(
            f"SELECT {g}'{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
            f"round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, "
            f"round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lineitem"
            + (f" GROUP BY {by}" if by else ""))
    return "\nUNION ALL\n".join(parts)


def _round_desc(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("mean", "std", "min", "q1", "median", "q3", "max")
                       else F.col(c) for c in df.columns])


@query("describe_numeric", "P9", sql=_desc_sql(None))
def describe_numeric(spark, sf):
    return _round_desc(profile.describe_numeric(load(spark, sf, "lineitem"), _DESC_COLS))


@query("describe_by_group", "P10", sql=_desc_sql("l_returnflag"))
def describe_by_group(spark, sf):
    return _round_desc(profile.describe_numeric(load(spark, sf, "lineitem"), _DESC_COLS, by="l_returnflag"))


@query("describe_category", "P11", sql="""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS rn,
             sum(n) OVER (PARTITION BY o_orderstatus) AS tot,
             count(*) OVER (PARTITION BY o_orderstatus) AS uq FROM c)
SELECT o_orderstatus, CAST(tot AS BIGINT) AS "count", uq AS "unique", o_orderpriority AS top, n AS freq
FROM r WHERE rn = 1""")
def describe_category(spark, sf):
    return profile.describe_category(load(spark, sf, "orders"), "o_orderpriority", by="o_orderstatus")


@query("cell_sizes", "P12", sql="WITH " + Q.VISITS.strip() + """
SELECT variant, device_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_ids,
       round(count(DISTINCT user_id) / count(*), 6) AS ids_per_row
FROM visits GROUP BY 1, 2""")
def cell_sizes(spark, sf):
    out = profile.cell_sizes(S.visits(spark, sf), ["variant", "device_type"], "user_id")
    return out.withColumn("ids_per_row", F.round("ids_per_row", 6))


@query("first_visit", "W1", sql="WITH " + Q.FIRST_VISITS.strip() + "\nSELECT * FROM first_visits")
def first_visit(spark, sf):
    return summary.first_per_key(S.visits(spark, sf), "user_id", ["date", "visit_id"])


def first_visits(spark, sf):
    return summary.first_per_key(S.visits(spark, sf), "user_id", ["date", "visit_id"])


def _stats_sql(by: str, metric: str, src: str) -> str:
    return (f"SELECT {by}, count({metric}) AS n, round(avg({metric}), 6) AS mean, "
            f"round(stddev_samp({metric}), 6) AS sd, "
            f"round(stddev_samp({metric}) / sqrt(count({metric})), 6) AS se FROM {src} GROUP BY {by}")


def _round_stats(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("mean", "sd", "se") else F.col(c) for c in df.columns])


@query("metric_by_cell", "A3 A4 A5", sql="WITH " + Q.FIRST_VISITS.strip() + "\n"
       + _stats_sql("variant, device_type", "shopping_pageviews", "first_visits"))
def metric_by_cell(spark, sf):
    return _round_stats(summary.group_stats(first_visits(spark, sf), ["variant", "device_type"],
                                            "shopping_pageviews"))


@query("daily_metric_se", "A5 D5h", sql="WITH " + Q.VISITS.strip() + "\n"
       + _stats_sql("date, variant, device_type", "shopping_pageviews", "visits"))
def daily_metric_se(spark, sf):
    return _round_stats(summary.group_stats(S.visits(spark, sf), ["date", "variant", "device_type"],
                                            "shopping_pageviews"))


@query("share_within_variant", "A10 W2 D6h X10", sql="WITH " + Q.FIRST_VISITS.strip() + """,
c AS (SELECT variant, CASE WHEN bottom_of_page_reached >= 1 THEN 'yes' ELSE 'no' END AS reached,
             count(*) AS n FROM first_visits GROUP BY 1, 2)
SELECT variant, reached, n, round(n * 100.0 / sum(n) OVER (PARTITION BY variant), 6) AS pct FROM c""")
def share_within_variant(spark, sf):
    fv = first_visits(spark, sf).withColumn(
        "reached", X.if_else(F.col("bottom_of_page_reached") >= 1, F.lit("yes"), F.lit("no")))
    c = fv.groupBy("variant", "reached").agg(F.count(F.lit(1)).alias("n"))
    return summary.with_share(c, "n", within="variant").withColumn("pct", F.round("pct", 6))


@query("clicked_after_reach", "A10 F3 F5", sql="WITH " + Q.FIRST_VISITS.strip() + """,
c AS (SELECT variant, CASE WHEN bottom_related_link_clicks >= 1 THEN 'yes' ELSE 'no' END AS clicked,
             count(*) AS n FROM first_visits WHERE bottom_of_page_reached >= 1 GROUP BY 1, 2)
SELECT variant, clicked, n, round(n * 100.0 / sum(n) OVER (PARTITION BY variant), 6) AS freq
FROM c WHERE variant <> 'control'""")
def clicked_after_reach(spark, sf):
    fv = first_visits(spark, sf).where(F.col("bottom_of_page_reached") >= 1).withColumn(
        "clicked", X.if_else(F.col("bottom_related_link_clicks") >= 1, F.lit("yes"), F.lit("no")))
    c = fv.groupBy("variant", "clicked").agg(F.count(F.lit(1)).alias("n"))
    out = summary.with_share(c, "n", within="variant", name="freq").where(F.col("variant") != "control")
    return out.withColumn("freq", F.round("freq", 6))


@query("share_total", "A9 F5", sql="WITH " + Q.FIRST_VISITS.strip() + """,
c AS (SELECT top_related_link_clicks, count(*) AS n FROM first_visits
      WHERE variant = 'top_and_bottom' AND device_type = 'desktop' GROUP BY 1)
SELECT top_related_link_clicks, n, round(n * 100.0 / sum(n) OVER (), 6) AS freq FROM c""")
def share_total(spark, sf):
    fv = first_visits(spark, sf).where((F.col("variant") == "top_and_bottom") & (F.col("device_type") == "desktop"))
    c = fv.groupBy("top_related_link_clicks").agg(F.count(F.lit(1)).alias("n"))
    return summary.with_share(c, "n", name="freq").withColumn("freq", F.round("freq", 6))


@query("report_roundtrip", "S1 S2 S3 S4 S5 S6 T4", sql="\nUNION ALL\n".join(
    f"SELECT '{fmt}' AS format, count(*) AS n_rows, round(sum(c_acctbal), 2) AS sum_acctbal, "
    f"count(DISTINCT c_mktsegment) AS n_segments, min(c_custkey) AS min_key FROM customer"
    for fmt in ("csv", "csv_latin1", "pipe", "json", "parquet")))
def report_roundtrip(spark, sf):
    """Customer rows written as CSV (UTF-8 and latin-1), pipe-delimited text,
    NDJSON and Parquet into a fresh folder under the shared checkpoint
    directory, read back with explicit schemas, and summarised per format."""
    import uuid

    from tessera.session import scratch_path
    from tessera.sources import files
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    schema = c.schema
    base = scratch_path(spark, f"roundtrip-{uuid.uuid4().hex}")
    files.write_table(c, f"{base}/csv", "csv", header=True)
    files.write_table(c, f"{base}/csv_latin1", "csv", header=True, encoding="ISO-8859-1")
    files.write_table(c, f"{base}/pipe", "csv", header=False, sep="|")
    files.write_table(c, f"{base}/json", "json")
    files.write_table(c, f"{base}/parquet", "parquet")
    back = {
        "csv": files.read_csv(spark, f"{base}/csv", schema),
        "csv_latin1": files.read_csv(spark, f"{base}/csv_latin1", schema, encoding="ISO-8859-1"),
        "pipe": files.read_csv(spark, f"{base}/pipe", schema, header=False, sep="|"),
        "json": files.read_json_lines(spark, f"{base}/json", schema),
        "parquet": files.read_table(spark, f"{base}/parquet", "parquet"),
    }
    parts = [d.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n_rows"),
                   F.round(F.sum("c_acctbal"), 2).alias("sum_acctbal"),
                   F.countDistinct("c_mktsegment").alias("n_segments"), F.min("c_custkey").alias("min_key"))
             for fmt, d in back.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
