"""Named queries that show single operators on data that exercises them: nulls, exact membership,
synthetic rows, order-dependent statistics, every branch of a policy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import basket, counts, evaluate, htest, models, prep, sampling, smote
from tessera.plans import sqlparts as Q
from tessera.plans.catalog_basic import first_visits
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources import standins as S
from tessera.sources.tables import load

_NULL_COLS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
_NULLS = "WITH " + Q.LINEITEM_NULLS.strip()


# ------------------------------------------------------------------ nulls

@query("corr_pairs_nulls", "N11", sql=_NULLS + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 8) AS r FROM li_nulls"
    for i, a in enumerate(_NULL_COLS) for b in _NULL_COLS[i + 1:]))
def corr_pairs_nulls(spark, sf):
    """Every pair over the rows where both are known."""
    return prep.corr_pairs(S.lineitem_with_nulls(spark, sf), _NULL_COLS).withColumn("r", F.round("r", 8))


@query("f_scores_nulls", "H2", sql=_NULLS + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NOT NULL AND l_extendedprice IS NOT NULL) AS n, "
    f"round(corr({f}, l_extendedprice), 8) AS r, round(pow(corr({f}, l_extendedprice), 2) / (1 - pow(corr({f}, l_extendedprice), 2)) "
    f"* (count(*) FILTER (WHERE {f} IS NOT NULL AND l_extendedprice IS NOT NULL) - 2), 4) AS f FROM li_nulls"
    for f in _NULL_COLS[:3]))
def f_scores_nulls(spark, sf):
    out = htest.f_scores(S.lineitem_with_nulls(spark, sf), "l_extendedprice", _NULL_COLS[:3], with_p=False)
    return out.select("feature", "n", F.round("r", 8).alias("r"), F.round("f", 4).alias("f"))


_TH = (0.1, 0.3, 0.5, 0.7, 0.9)


@query("threshold_rates_nulls", "E7 E8 E9", sql=_NULLS + """,
j AS (SELECT l_discount * 10 AS s, CASE WHEN l_tax IS NULL THEN NULL ELSE CAST(l_returnflag = 'R' AS INTEGER) END AS y FROM li_nulls)
""" + "\nUNION ALL\n".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, CAST(count_if(s > {t} AND y = 1) AS BIGINT) AS tp, CAST(count_if(s > {t} AND y = 0) AS BIGINT) AS fp, "
    f"CAST(count_if(s <= {t} AND y = 0) AS BIGINT) AS tn, CAST(count_if(s <= {t} AND y = 1) AS BIGINT) AS fn, "
    f"round(count_if((s > {t}) = (y = 1)) / count(*) FILTER (WHERE s IS NOT NULL AND y IS NOT NULL), 8) AS accuracy FROM j" for t in _TH))
def threshold_rates_nulls(spark, sf):
    """Rows without a score or without a label are in no cell and not in the accuracy."""
    li = S.lineitem_with_nulls(spark, sf).withColumn("score", F.col("l_discount") * 10).withColumn(
        "y", F.when(F.col("l_tax").isNotNull(), (F.col("l_returnflag") == "R").cast("int")))
    return evaluate.threshold_sweep(li, "y", "score", _TH).select("threshold", "tp", "fp", "tn", "fn", F.round("accuracy", 8).alias("accuracy"))


@query("regression_metrics_nulls", "E1", sql=_NULLS + """,
k AS (SELECT l_extendedprice AS y, l_quantity * (1000 + 5000 * l_tax) AS p FROM li_nulls WHERE l_extendedprice IS NOT NULL AND l_tax IS NOT NULL)
SELECT count(*) AS n, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 8) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse FROM k""")
def regression_metrics_nulls(spark, sf):
    li = S.lineitem_with_nulls(spark, sf).withColumn("p", F.col("l_quantity") * (1000 + 5000 * F.col("l_tax")))
    return evaluate.regression_metrics(li, "l_extendedprice", "p").select("n", F.round("r2", 8).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query("missing_policy_branches", "N2 N3 N4 N6", sql=_NULLS + """,
full_rows AS (SELECT * FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL),
holed AS (SELECT l_discount, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem),
kept AS (SELECT l_discount, l_tax, l_extendedprice FROM li_nulls WHERE NOT (l_discount IS NULL AND l_tax IS NULL AND l_extendedprice IS NULL))
SELECT 'keep' AS policy, count(*) AS n, round(sum(l_discount), 4) AS sum_discount, round(sum(l_tax), 4) AS sum_tax FROM full_rows
UNION ALL SELECT 'drop_rows', count(*), round(sum(l_discount), 4), round(sum(l_tax), 4) FROM holed WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL
UNION ALL SELECT 'impute_mean', count(*), round(sum(coalesce(l_discount, (SELECT avg(l_discount) FROM kept))), 4),
                 round(sum(coalesce(l_tax, (SELECT avg(l_tax) FROM kept))), 4) FROM kept""")
def missing_policy_branches(spark, sf):
    """All three branches: no nulls, nulls in at most a fifth of the rows, nulls in more."""
    whole = load(spark, sf, "lineitem")
    some = whole.withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
    out = None
    for frame, cols in ((whole, ["l_discount", "l_tax"]), (some, ["l_discount", "l_tax"]),
                        (S.lineitem_with_nulls(spark, sf), ["l_discount", "l_tax", "l_extendedprice"])):
        policy, clean = prep.missing_policy(frame, cols)
        row = clean.agg(F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_discount"), 4).alias("sum_discount"),
                        F.round(F.sum("l_tax"), 4).alias("sum_tax"))
        out = row if out is None else out.unionByName(row)
    return out


@query("sparse_columns_dropped", "N1", sql="""
SELECT 'id' AS "column", count(o_orderkey) AS n_known FROM orders
UNION ALL SELECT 'priority', count(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) FROM orders""")
def sparse_columns_dropped(spark, sf):
    """The columns that are left once those with more than 70 percent nulls are dropped."""
    key = F.col("o_orderkey")
    d = load(spark, sf, "orders").select(key.alias("id"), F.when(key % 8 == 0, F.col("o_orderstatus")).alias("status_joint"),
                                         F.when(key % 2 == 0, F.col("o_orderpriority")).alias("priority"))
    left = prep.drop_sparse_columns(d)
    counts = left.agg(*[F.count(c).alias(c) for c in left.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_known")) for c in left.columns])))


# ------------------------------------------------------------------ sampling, row by row

_ORDER = "((doc_id % 1000003 * 7919 + 42) % 1000003)"
_RANKED = f"""
WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}, doc_id) AS k,
                  count(*) OVER (PARTITION BY quality) AS n,
                  row_number() OVER (PARTITION BY toxic ORDER BY {_ORDER}, doc_id) AS kt FROM labels)"""


@query("split_members", "R2", sql=_RANKED + """
SELECT doc_id, CASE WHEN k <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_members(spark, sf):
    """Which row is in which part, not how many."""
    return sampling.stratified_split(load(spark, sf, "labels"), "quality", "doc_id", 0.2, 42, method="affine").select("doc_id", "split")


@query("fold_members", "R3", sql=_RANKED + """
SELECT doc_id, CAST(list_sum([CASE WHEN k > f * (n // 5) + least(f, n % 5) THEN 1 ELSE 0 END FOR f IN [1, 2, 3, 4]]) AS INTEGER) AS fold FROM r""")
def fold_members(spark, sf):
    return sampling.stratified_folds(load(spark, sf, "labels"), "quality", "doc_id", 5, 42, method="affine").select("doc_id", "fold")


@query("undersample_members", "R4", sql=_RANKED + """
SELECT doc_id, toxic FROM r WHERE kt <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))""")
def undersample_members(spark, sf):
    return sampling.undersample(load(spark, sf, "labels"), "toxic", "doc_id", 42, method="affine").select("doc_id", "toxic")


@query("oversample_draws", "R5", sql=f"""
WITH c AS (SELECT toxic, count(*) AS n, max(count(*)) OVER () AS m FROM labels GROUP BY toxic),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_ORDER}, doc_id) - 1 AS k FROM labels),
d AS (SELECT c.toxic, ((i % 1000003 * 7919 + 42) % 1000003) % c.n AS k, count(*) AS copies
      FROM c, LATERAL (SELECT unnest(range(c.m)) AS i) WHERE c.n < c.m GROUP BY 1, 2)
SELECT r.doc_id, r.toxic, CAST(d.copies AS BIGINT) AS copies FROM r JOIN d USING (toxic, k)
UNION ALL SELECT doc_id, toxic, 1 FROM labels WHERE toxic IN (SELECT toxic FROM c WHERE n = m)""")
def oversample_draws(spark, sf):
    """How often each row is drawn."""
    drawn = sampling.oversample(load(spark, sf, "labels"), "toxic", "doc_id", 42, method="affine")
    return drawn.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))


_SMOTE_COLS = ("total", "days", "customer")
_SMOTE_DATA = """
WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE 'other' END AS class, o_totalprice / 1000 AS total,
                  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 100 AS days, o_custkey / 100.0 AS customer FROM orders)"""


@query("smote", "R6", sql=_SMOTE_DATA + ", c AS (SELECT class, count(*) AS n, max(count(*)) OVER () AS m FROM d GROUP BY class)\n"
       "SELECT d.class, max(c.m) AS n, max(c.m - c.n) AS n_synthetic, " + ", ".join(
           f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}" for c in _SMOTE_COLS) + " FROM d JOIN c USING (class) GROUP BY d.class")
def smote_query(spark, sf):
    """Orders by status: class sizes after filling up, and bounds of every feature, which points on
    segments between rows of a class cannot leave."""
    o = load(spark, sf, "orders")
    d = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "P").otherwise("other").alias("class"),
                 (F.col("o_totalprice") / 1000).alias("total"),
                 (F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double") / 100).alias("days"),
                 (F.col("o_custkey") / 100.0).cast("double").alias("customer"))
    out = smote.smote(d, "class", _SMOTE_COLS, "id")
    bounds = [f(c).alias(f"{n}_{c}") for c in _SMOTE_COLS for n, f in (("min", F.min), ("max", F.max))]
    g = out.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"), *bounds)
    return g.select("class", "n", "n_synthetic", *[F.round(f"{m}_{c}", 6).alias(f"{m}_{c}") for c in _SMOTE_COLS for m in ("min", "max")])


# ------------------------------------------------------------------ least squares

@query("ols_diagnostics", "M1", sql="WITH " + Q.DOGS.strip() + """,
a AS (SELECT count(*) AS n, regr_slope(weight, height) AS b1, regr_intercept(weight, height) AS b0 FROM dogs),
e AS (SELECT l_orderkey, l_linenumber, height, weight, n, weight - (b0 + b1 * height) AS e FROM dogs, a),
s AS (SELECT max(n) AS n, sum(e * e) AS sse, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM e),
l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) AS ll, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) AS ku FROM s),
w AS (SELECT sum(pow(e - p, 2)) / (SELECT sse FROM s) AS dw FROM (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, height, weight) AS p FROM e))
SELECT round(ll, 4) AS log_likelihood, round(-2 * ll + 4, 4) AS aic, round(-2 * ll + 2 * ln(n), 4) AS bic, round(sk, 6) AS skew,
       round(ku, 6) AS kurtosis, round(n / 6.0 * (sk * sk + (ku - 3) * (ku - 3) / 4), 3) AS jarque_bera, round(dw, 8) AS durbin_watson FROM l, w""")
def ols_diagnostics(spark, sf):
    """The lower part of a regression summary: likelihood, information criteria, residual shape and
    the dependence of successive residuals."""
    d = S.dogs(spark, sf)
    fit = models.ols(d, "weight", ["height"])
    st = fit.stats()
    res = evaluate.residuals(fit.predict(d, "fitted"), "weight", "fitted")
    digits = {"log_likelihood": 4, "aic": 4, "bic": 4, "skew": 6, "kurtosis": 6, "jarque_bera": 3}
    dw = models.durbin_watson(res, "residual", ["l_orderkey", "l_linenumber", "height", "weight"])
    return dw.select(*[F.lit(round(st[k], n)).alias(k) for k, n in digits.items()], F.round("durbin_watson", 8).alias("durbin_watson"))


# ------------------------------------------------------------------ count models and jitter

_ZIP = "WITH RECURSIVE " + Q.FIRST_VISITS.strip() + """,
t AS (SELECT device_type AS s, variant AS g, shopping_pageviews AS y FROM first_visits WHERE shopping_pageviews IS NOT NULL),
g AS (SELECT s, g, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(y = 0) AS DOUBLE) AS n0, CAST(sum(y) AS DOUBLE) AS tot, sum(lgamma(y + 1.0)) AS lf
      FROM t GROUP BY 1, 2 HAVING sum(y) > 0),
it AS (SELECT s, g, tot / (n - n0) AS m, tot / (n - n0) AS lam, 0 AS i FROM g
       UNION ALL SELECT s, g, m, greatest(lam - (lam - m * (1 - exp(-lam))) / (1 - m * exp(-lam)), 1e-12), i + 1 FROM it WHERE i < 60 AND m > 1 + 1e-9),
r AS (SELECT g.*, CASE WHEN it.i = 60 THEN it.lam END AS lam,
             CASE WHEN it.i = 60 THEN 1 - (n - n0) / n / (1 - exp(-it.lam)) END AS p0
      FROM g JOIN it ON it.s = g.s AND it.g = g.g AND it.i = (SELECT max(i) FROM it i2 WHERE i2.s = g.s AND i2.g = g.g)),
f AS (SELECT s, g, n, n0, tot, lf, CASE WHEN p0 > 1e-10 THEN least(p0, 1 - 1e-10) ELSE 1e-10 END AS pi,
             CASE WHEN p0 > 1e-10 THEN lam ELSE tot / n END AS mu FROM r),
h AS (SELECT *, exp(-mu) AS q, pi + (1 - pi) * exp(-mu) AS a, pi * (1 - pi) AS w FROM f),
i AS (SELECT s, g, n, ln(pi / (1 - pi)) AS zeta, ln(mu) AS eta,
             n0 * ln(a) + (n - n0) * (ln(1 - pi) - mu) + tot * ln(mu) - lf AS ll,
             -(n0 * (w * (1 - 2 * pi) * (1 - q) / a - pow(w * (1 - q) / a, 2)) - (n - n0) * w) AS izz,
             -(n0 * (-(1 - pi) * q * mu * (1 - mu) / a - pow((1 - pi) * q * mu / a, 2)) - (n - n0) * mu) AS iee,
             -(n0 * (w * q * mu / a + w * (1 - q) * (1 - pi) * q * mu / (a * a))) AS ize FROM h),
v AS (SELECT *, iee / (izz * iee - ize * ize) AS vz, izz / (izz * iee - ize * ize) AS ve,
             row_number() OVER (PARTITION BY s ORDER BY g) AS j, count(*) OVER (PARTITION BY s) AS k, sum(ll) OVER (PARTITION BY s) AS tll,
             sum(n) OVER (PARTITION BY s) AS big FROM i),
c AS (SELECT s, 'zero' AS part, j, k, tll, big, zeta AS x, vz AS v FROM v UNION ALL SELECT s, 'count', j, k, tll, big, eta, ve FROM v),
e AS (SELECT *, avg(x) OVER (PARTITION BY s, part) AS mx, sum(v) OVER (PARTITION BY s, part) / (k * k) AS vs FROM c)
SELECT s AS device_type, part, '(Intercept)' AS term, round(mx, 6) AS estimate, round(sqrt(vs), 6) AS std_err, round(tll, 5) AS loglik,
       round(-2 * tll + 4 * k, 5) AS aic, round(-2 * tll + ln(big) * 2 * k, 5) AS bic FROM e WHERE j = 1
UNION ALL SELECT s, part, 'group' || CAST(j AS VARCHAR), round(x - mx, 6), round(sqrt(v * (1 - 2.0 / k) + vs), 6), round(tll, 5),
       round(-2 * tll + 4 * k, 5), round(-2 * tll + ln(big) * 2 * k, 5) FROM e WHERE j < k"""


@query("zip_estimates", "M12", sql=_ZIP)
def zip_estimates(spark, sf):
    """Zero-inflated Poisson fits with their errors and information criteria, rounded."""
    out = counts.fit_count_models(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", ("zip",))
    return out.select("device_type", "part", "term", *[F.round(c, d).alias(c) for c, d in (
        ("estimate", 6), ("std_err", 6), ("loglik", 5), ("aic", 5), ("bic", 5))])


@query("log_jitter_affine", "X8 H13", sql="WITH " + Q.FIRST_VISITS.strip() + """,
l AS (SELECT device_type, ln(shopping_pageviews + ((user_id % 1000003 * 7919 + 7) % 1000003) / 1000003.0 * (0.1 - 0.01) + 0.01) AS v FROM first_visits)
SELECT device_type, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max
FROM l GROUP BY 1""")
def log_jitter_affine(spark, sf):
    fv = first_visits(spark, sf).withColumn("v", X.ln_jitter("shopping_pageviews", 7, key="user_id", method="affine"))
    out = htest.distribution_profile(fv, "v", "device_type")
    return out.select("device_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")])


# ------------------------------------------------------------------ sources, rules, buckets

@query("pipe_table", "S3", sql="""
SELECT count(*) AS n, round(avg(l_extendedprice), 6) AS mean_y, round(avg(l_quantity), 6) AS mean_x0, round(sum(l_discount), 4) AS sum_x1,
       count(CASE WHEN l_linenumber <> 1 THEN l_tax END) AS known_x2 FROM lineitem""")
def pipe_table(spark, sf):
    """A headerless numeric table with an empty field here and there, read under generated names."""
    path = scratch_path(spark, f"pipe-{uuid.uuid4().hex}")
    li = load(spark, sf, "lineitem")
    files.write_table(li.select("l_extendedprice", "l_quantity", "l_discount", F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("t")),
                      path, "csv", header=False, sep="|")
    t = files.read_pipe_table(spark, path, 3)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.avg("x0"), 6).alias("mean_x0"),
                 F.round(F.sum("x1"), 4).alias("sum_x1"), F.count("x2").alias("known_x2"))


@query("line_quantity_buckets", "X13 A6", sql="""
SELECT CASE WHEN l_quantity >= 10 THEN '>=10' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS label, count(*) AS n
FROM lineitem GROUP BY 1""")
def line_quantity_buckets(spark, sf):
    return load(spark, sf, "lineitem").groupBy(X.count_bucket("l_quantity").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("rule_matrix_wide", "B7 A8", sql="""
WITH ev AS (SELECT DISTINCT user_id AS u, event_type AS t FROM events), n AS (SELECT count(DISTINCT u) AS n FROM ev),
s AS (SELECT t, count(*) AS c FROM ev GROUP BY t),
p AS (SELECT a.t AS x, b.t AS y, count(*) AS c FROM ev a JOIN ev b ON a.u = b.u AND a.t <> b.t GROUP BY 1, 2)
SELECT p.x AS antecedent, round(max(CASE WHEN y = 'click' THEN p.c / s.c END), 8) AS click, round(max(CASE WHEN y = 'error' THEN p.c / s.c END), 8) AS error,
       round(max(CASE WHEN y = 'purchase' THEN p.c / s.c END), 8) AS purchase, round(max(CASE WHEN y = 'signup' THEN p.c / s.c END), 8) AS signup,
       round(max(CASE WHEN y = 'view' THEN p.c / s.c END), 8) AS view FROM p JOIN s ON p.x = s.t GROUP BY p.x""")
def rule_matrix_wide(spark, sf):
    """Confidence of every rule between two kinds of events, one column for each consequent."""
    ev = load(spark, sf, "events").select("user_id", "event_type").distinct()
    bk = ev.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("items"))
    sets = basket.frequent_itemsets(bk, 1e-9).where(F.col("size") <= 2)
    rules = basket.association_rules(sets, "support", 0.0)
    wide = basket.rule_matrix(rules, wide=True)
    return wide.select("antecedent", *[F.round(c, 8).alias(c) for c in wide.columns if c != "antecedent"])
