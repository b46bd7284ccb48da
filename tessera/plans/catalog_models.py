"""Named queries: scalar cleaning, feature preparation, sampling, evaluation,
models and the end-to-end studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import evaluate, models, prep, sampling
from tessera.plans import sqlparts as Q
from tessera.plans import studies
from tessera.plans.catalog_basic import first_visits
from tessera.plans.registry import query
from tessera.sources import standins as S
from tessera.sources.tables import load

_COUNT_COLS = ("total_pageviews", "shopping_pageviews", "ad_clicks", "shares", "bottom_of_page_reached",
               "bottom_related_link_clicks", "top_related_link_clicks")


@query("clean_types", "X1 X2 S4", sql="WITH " + Q.VISITS.strip() + """,
raw AS (SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(date, '%Y%m%d') AS date, variant, device_type, """
       + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _COUNT_COLS) + """ FROM visits)
SELECT CAST(trunc(TRY_CAST(user_id AS DOUBLE)) AS INTEGER) AS userid, CAST(TRY_STRPTIME(date, '%Y%m%d') AS DATE) AS date,
       variant, device_type, """ + ", ".join(
    f"CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS INTEGER) AS {c}" for c in _COUNT_COLS) + " FROM raw")
def clean_types(spark, sf):
    raw = S.visits_raw_text(spark, sf)
    return raw.select(X.to_int("user_id").alias("userid"), X.parse_date("date", "yyyyMMdd").alias("date"),
                      "variant", "device_type", *[X.to_int(c).alias(c) for c in _COUNT_COLS])


_CLEAN_COLS = ("id", "loan_status", "emp_length", "purpose", "addr_state", "home_ownership", "annual_inc",
               "dti", "revol_bal", "log_annual_inc", "log_revol_bal", "total_monthly_debt", "age_credit")


@query("clean_loans", "X3 X4 X7 X9 X11 X15 N13 F2 F4 F6", sql="WITH " + Q.CLEAN_LOANS.strip() + """
SELECT id, loan_status, emp_length, purpose, addr_state, home_ownership, annual_inc, round(dti, 8) AS dti, revol_bal,
       round(log_annual_inc, 8) AS log_annual_inc, round(log_revol_bal, 8) AS log_revol_bal,
       total_monthly_debt, age_credit FROM clean_loans""")
def clean_loans(spark, sf):
    out = studies.clean_loans(S.loans(spark, sf))
    return out.select(*[F.round(c, 8).alias(c) if c in ("dti", "log_annual_inc", "log_revol_bal") else F.col(c)
                        for c in _CLEAN_COLS])


@query("impute_median", "N5", sql="WITH " + Q.CLEAN_LOANS.strip() + """,
m AS (SELECT quantile_cont(annual_inc, 0.5) AS mi, quantile_cont(emp_length, 0.5) AS me FROM clean_loans)
SELECT id, round(coalesce(annual_inc, mi), 6) AS annual_inc, round(coalesce(CAST(emp_length AS DOUBLE), me), 6) AS emp_length
FROM clean_loans, m""")
def impute_median(spark, sf):
    out = prep.impute(studies.clean_loans(S.loans(spark, sf)), ["annual_inc", "emp_length"], "median")
    return out.select("id", F.round("annual_inc", 6).alias("annual_inc"), F.round("emp_length", 6).alias("emp_length"))


_IMP = ("l_discount", "l_tax", "l_extendedprice")


@query("impute_mean", "N4", sql="WITH " + Q.LINEITEM_NULLS.strip() + """,
m AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}" for c in _IMP) + """ FROM li_nulls)
SELECT l_orderkey, l_linenumber, """ + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in _IMP) + """
FROM li_nulls, m""")
def impute_mean(spark, sf):
    out = prep.impute(S.lineitem_with_nulls(spark, sf), _IMP, "mean")
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _IMP])


@query("missing_policy", "N2 N3 N6", sql="WITH " + Q.LINEITEM_NULLS.strip() + """,
s AS (SELECT avg(CASE WHEN l_discount IS NULL OR l_tax IS NULL OR l_extendedprice IS NULL THEN 1.0 ELSE 0.0 END) AS share,
             count(*) AS n_in FROM li_nulls),
kept AS (SELECT * FROM li_nulls WHERE NOT (l_discount IS NULL AND l_tax IS NULL AND l_extendedprice IS NULL)),
m AS (SELECT avg(l_discount) AS md, avg(l_tax) AS mt, avg(l_extendedprice) AS me, count(*) AS n_out FROM kept)
SELECT CASE WHEN share = 0 THEN 'keep' WHEN share <= 0.2 THEN 'drop_rows' ELSE 'impute_mean' END AS policy,
       n_in, n_out, round(sum(coalesce(l_discount, md)), 4) AS sum_discount, round(sum(coalesce(l_tax, mt)), 4) AS sum_tax
FROM kept, s, m GROUP BY ALL""")
def missing_policy(spark, sf):
    li = S.lineitem_with_nulls(spark, sf)
    policy, out = prep.missing_policy(li, list(_IMP))
    n_in = li.count()
    return out.agg(F.lit(policy).alias("policy"), F.lit(n_in).cast("long").alias("n_in"),
                   F.count(F.lit(1)).alias("n_out"),
                   F.round(F.sum("l_discount"), 4).alias("sum_discount"), F.round(F.sum("l_tax"), 4).alias("sum_tax"))


_VAR_COLS = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")


@query("variance_filter", "N7", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(stddev_samp({c}), 6) AS sd, stddev_samp({c}) >= 0.2 AS kept FROM lineitem"
    for c in _VAR_COLS))
def variance_filter(spark, sf):
    out = prep.variance_report(load(spark, sf, "lineitem"), _VAR_COLS, 0.2)
    return out.select("column", F.round("sd", 6).alias("sd"), "kept")


@query("standardise", "N9", sql="""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd
           FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_discount - md) / sd, 6) AS l_discount
FROM lineitem, s""")
def standardise(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = prep.standardise(li, ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                      F.round("l_discount", 6).alias("l_discount"))


@query("minmax", "N10 X18", sql="""
WITH t AS (SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1),
r AS (SELECT min(total) AS lo, max(total) AS hi FROM t)
SELECT l_suppkey, total, round((total - lo) / (hi - lo), 3) AS scaled FROM t, r""")
def minmax(spark, sf):
    t = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"))
    return prep.minmax_scale(t, "total")


_CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


@query("corr_pairs", "N11 T3", sql="SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 8) AS r FROM lineitem"
    for a, b in _CORR_PAIRS) + ") ORDER BY r DESC, feature_a, feature_b LIMIT 10")
def corr_pairs(spark, sf):
    out = prep.corr_pairs(load(spark, sf, "lineitem"), _CORR_COLS).withColumn("r", F.round("r", 8))
    return out.orderBy(F.desc("r"), "feature_a", "feature_b").limit(10)


@query("collinear_flag", "N12", sql="SELECT round(max(r), 8) AS max_abs_r, max(r) >= 0.8 AS collinear FROM (" + "\nUNION ALL\n".join(
    f"SELECT abs(corr({a}, {b})) AS r FROM lineitem" for a, b in _CORR_PAIRS) + ")")
def collinear_flag(spark, sf):
    out = prep.collinear_flag(prep.corr_pairs(load(spark, sf, "lineitem"), _CORR_COLS), 0.8)
    return out.select(F.round("max_abs_r", 8).alias("max_abs_r"), "collinear")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot", "N8", sql="SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS seg_{s}" for s in _SEGMENTS) + " FROM customer")
def one_hot(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    lv = prep.levels_of(c, "c_mktsegment")
    return prep.one_hot_columns(c, "c_mktsegment", lv, prefix="seg").drop("c_mktsegment")


@query("contrasts", "N14", sql="WITH " + Q.FIRST_VISITS.strip() + """
SELECT user_id, variant,
       CASE WHEN variant = 'bottom' THEN 1 WHEN variant = 'top_and_bottom' THEN -1 ELSE 0 END AS variant1,
       CASE WHEN variant = 'control' THEN 1 WHEN variant = 'top_and_bottom' THEN -1 ELSE 0 END AS variant2
FROM first_visits""")
def contrasts(spark, sf):
    fv = first_visits(spark, sf).select("user_id", "variant")
    return prep.sum_contrasts(fv, "variant", sorted(S.VARIANTS))


_AFFINE = "((l_orderkey * 8 + l_linenumber) % 1000003 * 7919 + 42) % 1000003 / 1000003.0"


@query("hash_split", "R1", sql="WITH " + Q.DOGS.strip() + f"""
SELECT CASE WHEN {_AFFINE} < 0.1 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       round(avg(weight), 6) AS mean_weight FROM dogs GROUP BY 1""")
def hash_split(spark, sf):
    d = S.dogs(spark, sf).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    s = sampling.hash_split(d, "row_key", 0.1, 42, method="affine")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("stratified_split", "R2", sql="""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, 'train' AS split, CAST(round(n * 0.8) AS BIGINT) AS n FROM c
UNION ALL SELECT quality, 'test', CAST(n - round(n * 0.8) AS BIGINT) FROM c""")
def stratified_split(spark, sf):
    s = sampling.stratified_split(load(spark, sf, "labels"), "quality", "doc_id", 0.2, 42)
    return s.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"))


@query("folds", "R3", sql="""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, CAST(f AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM c, range(5) t(f)""")
def folds(spark, sf):
    s = sampling.stratified_folds(load(spark, sf, "labels"), "quality", "doc_id", 5, 42)
    return s.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("undersample", "R4 U2", sql="""
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT toxic, (SELECT min(n) FROM c) AS n FROM c""")
def undersample(spark, sf):
    s = sampling.undersample(load(spark, sf, "labels"), "toxic", "doc_id", 42)
    return s.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("oversample", "R5 U2", sql="""
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT toxic, (SELECT max(n) FROM c) AS n, count(*) AS n_distinct_rows FROM labels GROUP BY toxic""")
def oversample(spark, sf):
    s = sampling.oversample(load(spark, sf, "labels"), "toxic", "doc_id", 42)
    # every original row of the largest class survives; the smaller class is drawn with replacement
    g = s.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("__d"))
    full = load(spark, sf, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n_distinct_rows"))
    return g.join(full, "toxic").select("toxic", "n", "n_distinct_rows")


_SCORE = "CAST(l_returnflag = 'R' AS INTEGER)"


@query("roc_points", "E4 E7", sql=f"""
WITH s AS (SELECT l_discount AS score, sum({_SCORE}) AS pos, sum(1 - {_SCORE}) AS neg FROM lineitem GROUP BY 1),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)
SELECT round(score, 6) AS threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, round(fp / n, 8) AS fpr,
       round(tp / p, 8) AS tpr, round(1 - tp / p, 8) AS fnr FROM c""")
def roc_points(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    out = evaluate.roc_points(li, "y", "l_discount")
    return out.select(F.round("threshold", 6).alias("threshold"), F.col("tp").cast("double").alias("tp"),
                      F.col("fp").cast("double").alias("fp"),
                      *[F.round(c, 8).alias(c) for c in ("fpr", "tpr", "fnr")])


_AUC_SQL = """
WITH x AS (SELECT {scope} AS s, {y} AS y, l_discount AS v FROM lineitem),
r AS (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS mr FROM x),
a AS (SELECT s, CAST(count_if(y = 1) AS DOUBLE) AS np, CAST(count_if(y <> 1) AS DOUBLE) AS nn,
             sum(CASE WHEN y = 1 THEN mr END) AS rp FROM r GROUP BY s)
SELECT {sel} CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, round((rp - np * (np + 1) / 2) / (np * nn), 8) AS auc FROM a"""


@query("auc", "E5 W3", sql=_AUC_SQL.format(scope="1", y=_SCORE, sel=""))
def auc(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return evaluate.auc(li, "y", "l_discount").withColumn("auc", F.round("auc", 8))


@query("auc_by_fold", "E6 W3", sql=_AUC_SQL.format(scope="CAST(l_orderkey % 5 AS INTEGER)", y=_SCORE,
                                                    sel="s AS fold,"))
def auc_by_fold(spark, sf):
    li = (load(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
          .withColumn("fold", (F.col("l_orderkey") % 5).cast("int")))
    return evaluate.auc(li, "y", "l_discount", "fold").withColumn("auc", F.round("auc", 8))


_TH = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query("threshold_sweep", "E7 E8 E9 X16", sql="\nUNION ALL\n".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, "
    f"CAST(count_if(l_discount * 10 > {t} AND l_returnflag = 'R') AS BIGINT) AS tp, "
    f"CAST(count_if(l_discount * 10 > {t} AND l_returnflag <> 'R') AS BIGINT) AS fp, "
    f"CAST(count_if(NOT l_discount * 10 > {t} AND l_returnflag <> 'R') AS BIGINT) AS tn, "
    f"CAST(count_if(NOT l_discount * 10 > {t} AND l_returnflag = 'R') AS BIGINT) AS fn FROM lineitem" for t in _TH))
def threshold_sweep(spark, sf):
    li = (load(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
          .withColumn("score", F.col("l_discount") * 10))
    return evaluate.threshold_sweep(li, "y", "score", _TH).select("threshold", "tp", "fp", "tn", "fn")


@query("threshold_rates", "E8 E9", sql="SELECT threshold, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, "
       "round(fp / (fp + tn), 8) AS fpr, round(fn / (fn + tp), 8) AS fnr FROM (" + "\nUNION ALL\n".join(
           f"SELECT CAST({t} AS DOUBLE) AS threshold, "
           f"count_if(l_discount * 10 > {t} AND l_returnflag = 'R') AS tp, "
           f"count_if(l_discount * 10 > {t} AND l_returnflag <> 'R') AS fp, "
           f"count_if(NOT l_discount * 10 > {t} AND l_returnflag <> 'R') AS tn, "
           f"count_if(NOT l_discount * 10 > {t} AND l_returnflag = 'R') AS fn FROM lineitem" for t in _TH) + ")")
def threshold_rates(spark, sf):
    li = (load(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
          .withColumn("score", F.col("l_discount") * 10))
    out = evaluate.threshold_sweep(li, "y", "score", _TH)
    return out.select("threshold", *[F.round(c, 8).alias(c) for c in ("accuracy", "fpr", "fnr")])


@query("quantile_cutoff", "E10", sql="SELECT round(quantile_cont(o_totalprice, 0.8), 6) AS cutoff FROM orders")
def quantile_cutoff(spark, sf):
    return evaluate.approval_cutoff(load(spark, sf, "orders"), "o_totalprice", 0.2).select(
        F.round("cutoff", 6).alias("cutoff"))


_OLS1 = """
a AS (SELECT count(*) AS n, regr_slope(weight, height) AS b1, regr_intercept(weight, height) AS b0,
             regr_sxx(weight, height) AS sxx, regr_syy(weight, height) AS syy, regr_sxy(weight, height) AS sxy,
             avg(height) AS mx FROM dogs),
e AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM a)"""


@query("ols_summary", "M1", sql="WITH " + Q.DOGS.strip() + "," + _OLS1 + """
SELECT 'Intercept' AS term, round(b0, 6) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS std_err,
       round(b0 / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) AS t FROM e
UNION ALL
SELECT 'height', round(b1, 6), round(sqrt(s2 / sxx), 6), round(b1 / sqrt(s2 / sxx), 4) FROM e""")
def ols_summary(spark, sf):
    fit = models.ols(S.dogs(spark, sf), "weight", ["height"])
    c = fit.coefficients(spark)
    return c.select("term", F.round("coef", 6).alias("coef"), F.round("std_err", 6).alias("std_err"),
                    F.round("t", 4).alias("t"))


@query("ols_fit_stats", "M1 E1", sql="WITH " + Q.DOGS.strip() + "," + _OLS1 + """
SELECT n, round(1 - (syy - sxy * sxy / sxx) / syy, 8) AS r2,
       round(1 - (1 - (1 - (syy - sxy * sxy / sxx) / syy)) * (n - 1) / (n - 2), 8) AS adj_r2,
       round(sqrt((syy - sxy * sxy / sxx) / n), 6) AS rmse,
       round((sxy * sxy / sxx) / ((syy - sxy * sxy / sxx) / (n - 2)), 4) AS f FROM e""")
def ols_fit_stats(spark, sf):
    st = models.ols(S.dogs(spark, sf), "weight", ["height"]).stats()
    return spark.createDataFrame([(int(st["n"]), round(st["r2"], 8), round(st["adj_r2"], 8), round(st["rmse"], 6),
                                   round(st["f"], 4))], "n long, r2 double, adj_r2 double, rmse double, f double")


@query("ols_two_predictors", "M1 X12", sql="WITH " + Q.DOGS.strip() + """,
d AS (SELECT weight AS y, height AS x1, CAST(gender = 'male' AS DOUBLE) AS x2 FROM dogs),
m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM d),
s AS (SELECT sum((x1 - m1) * (x1 - m1)) AS s11, sum((x2 - m2) * (x2 - m2)) AS s22, sum((x1 - m1) * (x2 - m2)) AS s12,
             sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y FROM d, m),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT 'Intercept' AS term, round(my - b1 * m1 - b2 * m2, 6) AS coef FROM b, m
UNION ALL SELECT 'height', round(b1, 6) FROM b UNION ALL SELECT 'sex', round(b2, 6) FROM b""")
def ols_two_predictors(spark, sf):
    d = S.dogs(spark, sf).withColumn("sex", X.replace_values("gender", {"male": 1.0, "female": 0.0}))
    fit = models.ols(d, "weight", ["height", "sex"])
    return fit.coefficients(spark).select("term", F.round("coef", 6).alias("coef"))


@query("residuals", "E2", sql="WITH " + Q.DOGS.strip() + """,
a AS (SELECT regr_slope(weight, height) AS b1, regr_intercept(weight, height) AS b0 FROM dogs)
SELECT l_orderkey, l_linenumber, round(b0 + b1 * height, 6) AS fitted, round(weight - (b0 + b1 * height), 6) AS residual
FROM dogs, a""")
def residuals(spark, sf):
    d = S.dogs(spark, sf)
    fit = models.ols(d, "weight", ["height"])
    r = evaluate.residuals(fit.predict(d, "fitted"), "weight", "fitted")
    return r.select("l_orderkey", "l_linenumber", F.round("fitted", 6).alias("fitted"),
                    F.round("residual", 6).alias("residual"))


_REP_AFFINE = "((l_orderkey * 8 + l_linenumber) % 1000003 * 7919 + 42 + r * 104729) % 1000003 / 1000003.0"


@query("holdout_rmse", "R7 E3", sql="WITH " + Q.DOGS.strip() + f""",
rep AS (SELECT *, CASE WHEN {_REP_AFFINE} < 0.1 THEN 'test' ELSE 'train' END AS split
        FROM dogs, range(1, 11) t(r)),
f AS (SELECT r, regr_slope(weight, height) AS b1, regr_intercept(weight, height) AS b0 FROM rep
      WHERE split = 'train' GROUP BY r)
SELECT CAST(r AS INTEGER) AS replicate, round(sqrt(avg(pow(weight - (b0 + b1 * height), 2))), 6) AS rmse,
       count(*) AS n_test FROM rep JOIN f USING (r) WHERE split = 'test' GROUP BY r""")
def holdout_rmse(spark, sf):
    d = S.dogs(spark, sf).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return studies.holdout_rmse(d).withColumn("rmse", F.round("rmse", 6))


@query("repay_finance", "C2 A1 A3 U1 J2 X10", sql="""
WITH asg AS (SELECT o_custkey AS customer_id, l_partkey AS product_id, o_orderstatus AS st,
                    CAST(l_returnflag <> 'R' AS INTEGER) AS purchased
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O')),
po AS (SELECT st, product_id, count(*) AS q, p_retailprice / 1000.0 * 0.6 AS cost, p_retailprice / 1000.0 AS retail
       FROM asg JOIN part ON p_partkey = product_id GROUP BY st, product_id, p_retailprice),
pp AS (SELECT product_id, avg(cost) AS cost, avg(retail) AS retail FROM po GROUP BY product_id),
t AS (SELECT (SELECT sum(q * cost) FROM po WHERE st = 'F') AS loan_amount,
             (SELECT sum(q * cost) FROM po WHERE st = 'O') AS next_order_amount,
             (SELECT sum(CASE WHEN purchased = 1 THEN retail - 0.6 ELSE -1.2 END)
              FROM asg LEFT JOIN pp USING (product_id)) AS amount_received)
SELECT round(loan_amount, 4) AS loan_amount, round(next_order_amount, 4) AS next_order_amount,
       round(amount_received, 4) AS amount_received,
       round(amount_received - (loan_amount + next_order_amount), 4) AS profit,
       CASE WHEN amount_received - (loan_amount + next_order_amount) >= 0 THEN 'Yes' ELSE 'No' END AS decision FROM t""")
def repay_finance(spark, sf):
    # next month with its observed outcome as the given purchase flag
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nxt = (li.join(o.where(F.col("o_orderstatus") == "O"), li.l_orderkey == o.o_orderkey)
           .select(F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"),
                   (F.col("l_returnflag") != "R").cast("int").alias("purchased")))
    out = studies.finance(S.purchase_order(spark, sf, "last"), S.purchase_order(spark, sf, "next"),
                          S.assortment(spark, sf, "last"), nxt)
    return out.select(*[F.round(c, 4).alias(c) for c in ("loan_amount", "next_order_amount", "amount_received", "profit")],
                      "decision")


@query("enrich_assortment", "J2 J3 J5 X5 X17 F1", sql="""
WITH cf AS (SELECT c_custkey AS customer_id, c_mktsegment AS age_bucket, CAST(c_acctbal > 0 AS VARCHAR) AS rc,
                   c_custkey % 6 AS a, c_nationkey % 6 AS b FROM customer),
g AS (SELECT * FROM (VALUES (0, 'ECONOMY'), (1, 'LARGE'), (2, 'MEDIUM'), (3, 'PROMO'), (4, 'SMALL'), (5, 'STANDARD')) v(i, name)),
lc AS (SELECT DISTINCT customer_id, age_bucket, rc AS is_returning_customer, genre FROM (
         SELECT customer_id, age_bucket, rc, CASE WHEN customer_id % 10 = 0 THEN NULL ELSE ga.name END AS genre
         FROM cf JOIN g ga ON ga.i = cf.a
         UNION ALL
         SELECT customer_id, age_bucket, rc, CASE WHEN customer_id % 10 = 0 THEN NULL ELSE gb.name END
         FROM cf JOIN g gb ON gb.i = cf.b)),
asg AS (SELECT o_custkey AS customer_id, l_partkey AS product_id, CAST(l_returnflag <> 'R' AS INTEGER) AS purchased
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
pf AS (SELECT p_partkey AS product_id, p_type AS genre FROM part),
m AS (SELECT a.customer_id, coalesce(pf.genre, '-2') AS genre, a.purchased FROM asg a LEFT JOIN pf USING (product_id))
SELECT m.genre, coalesce(lc.age_bucket, '-2') AS age_bucket, count(*) AS n, CAST(sum(m.purchased) AS BIGINT) AS n_purchased
FROM lc RIGHT JOIN m ON lc.customer_id = m.customer_id AND lc.genre = m.genre
GROUP BY 1, 2""")
def enrich_assortment(spark, sf):
    merged = studies.purchase_model_frame(spark, sf, "last")
    return merged.groupBy("genre", "age_bucket").agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum("purchased").cast("long").alias("n_purchased"))


@query("sales_study", "C6 J1 P6 T1 T2 A6 X13 A9", sql="WITH " + Q.PRODUCT_SALES.strip() + ",\n" + Q.SALES.strip().replace(
    ",\nproduct AS (SELECT p_partkey AS product_id, p_name AS product_name FROM part)", "") + """,
tot AS (SELECT t.product_id, p.product_name, t.quantity
        FROM (SELECT product_id, sum(quantity) AS quantity FROM product_sales GROUP BY 1) t JOIN product p USING (product_id)),
cov AS (SELECT (SELECT count(DISTINCT s.product_id) FROM product_sales s SEMI JOIN product USING (product_id)) * 100.0
               / (SELECT count(DISTINCT product_id) FROM product) AS pct),
pm AS (SELECT member_id, sum(quantity) AS quantity FROM sales GROUP BY 1),
lab AS (SELECT CASE WHEN quantity >= 10 THEN '>=10' ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS label,
               count(*) AS n FROM pm GROUP BY 1)
SELECT 'coverage' AS section, 'pct_used' AS item, round(pct, 6) AS value FROM cov
UNION ALL SELECT * FROM (SELECT 'top', concat_ws(':', CAST(product_id AS VARCHAR), product_name), round(quantity, 6)
                         FROM tot ORDER BY quantity DESC, product_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bottom', concat_ws(':', CAST(product_id AS VARCHAR), product_name), round(quantity, 6)
                         FROM tot ORDER BY quantity, product_id LIMIT 10)
UNION ALL SELECT 'buyer_bucket_pct', label, round(n * 100.0 / sum(n) OVER (), 6) FROM lab""")
def sales_study(spark, sf):
    return studies.sales_study(spark, sf)


@query("ab_report", "C3 H4-H11 W3")
def ab_report(spark, sf):
    return studies.ab_report(first_visits(spark, sf))


@query("regression_study", "C5 M1 E1 E3 H1 H3 D4h")
def regression_study(spark, sf):
    return studies.regression_study(spark, sf)


_FR_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "p_retailprice", "p_size")


@query("feature_ranking", "C1 M2 M3 M4 N6 N7 N9 N10 N11 N12 H2 X18 T4")
def feature_ranking(spark, sf):
    li = load(spark, sf, "lineitem")
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    d = li.join(p, li.l_partkey == p.p_partkey).select("l_extendedprice", *_FR_FEATURES)
    return studies.feature_ranking(d, "l_extendedprice", _FR_FEATURES)


@query("purchase_validation", "E6 R3 M5 N8 C2")
def purchase_validation(spark, sf):
    return studies.purchase_validation(spark, sf)


@query("purchase_thresholds", "C2 E7 E8 E9 R1 M5")
def purchase_thresholds(spark, sf):
    return studies.purchase_thresholds(spark, sf)


@query("repay_decision", "C2 M5 M8 X16 J4")
def repay_decision(spark, sf):
    return studies.repay_decision(spark, sf)


@query("loan_study", "C4 M5 M6 M7 E5 R2 R4 R5 R6 N5 N8 N9 J6")
def loan_study(spark, sf):
    return studies.loan_study(spark, sf)


@query("loan_validation", "C4 E6 R3 M5 M6 M7")
def loan_validation(spark, sf):
    return studies.loan_validation(spark, sf)


@query("feature_lists", "C1 H2 T4")
def feature_lists(spark, sf):
    li = load(spark, sf, "lineitem")
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    d = li.join(p, li.l_partkey == p.p_partkey).select("l_extendedprice", *_FR_FEATURES)
    return studies.feature_lists(d, "l_extendedprice", _FR_FEATURES)


@query("poisson_means", "M11", sql="WITH " + Q.FIRST_VISITS.strip() + """
SELECT device_type, variant AS "group", count(shopping_pageviews) AS n, CAST(sum(shopping_pageviews) AS DOUBLE) AS total,
       round(avg(shopping_pageviews), 8) AS mean, round(ln(NULLIF(avg(shopping_pageviews), 0)), 8) AS eta,
       round(1 / NULLIF(sqrt(sum(shopping_pageviews)), 0), 8) AS se_eta
FROM first_visits GROUP BY 1, 2""")
def poisson_means(spark, sf):
    from tessera.operators import counts
    out = counts.poisson_means(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type")
    return out.select("device_type", "group", "n", "total",
                      *[F.round(c, 8).alias(c) for c in ("mean", "eta", "se_eta")])


@query("count_models", "M11 M12 M13 M14 M15 N14")
def count_models(spark, sf):
    from tessera.operators import counts
    return counts.fit_count_models(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type")


@query("class_rate_by_group", "A11 X15 F4", sql="WITH " + Q.CLEAN_LOANS.strip() + """
SELECT purpose, count(*) AS n, round(avg(CASE WHEN loan_status = 'Default' THEN 1.0 ELSE 0.0 END), 8) AS rate
FROM clean_loans GROUP BY purpose HAVING avg(CASE WHEN loan_status = 'Default' THEN 1.0 ELSE 0.0 END) > 0""")
def class_rate_by_group(spark, sf):
    from tessera.operators import summary
    cl = studies.clean_loans(S.loans(spark, sf))
    out = summary.class_rate(cl, "purpose", F.col("loan_status") == "Default")
    return out.withColumn("rate", F.round("rate", 8)).orderBy("rate")


@query("class_rate_interval", "A12 X15", sql="WITH " + Q.CLEAN_LOANS.strip() + """,
r AS (SELECT home_ownership, count(*) AS n, avg(CASE WHEN loan_status = 'Default' THEN 1.0 ELSE 0.0 END) AS rate
      FROM clean_loans GROUP BY 1)
SELECT home_ownership, n, round(rate, 8) AS rate,
       round(rate - 1.959963984540054 * sqrt(rate * (1 - rate) / n), 8) AS low,
       round(rate + 1.959963984540054 * sqrt(rate * (1 - rate) / n), 8) AS high FROM r""")
def class_rate_interval(spark, sf):
    from tessera.operators import summary
    cl = studies.clean_loans(S.loans(spark, sf))
    out = summary.rate_interval(cl, "home_ownership", F.col("loan_status") == "Default")
    return out.select("home_ownership", "n", *[F.round(c, 8).alias(c) for c in ("rate", "low", "high")])


@query("bootstrap_interval", "A12")
def bootstrap_interval(spark, sf):
    from tessera.operators import summary
    cl = studies.clean_loans(S.loans(spark, sf)).withColumn(
        "is_default", (F.col("loan_status") == "Default").cast("int"))
    return summary.bootstrap_interval(cl, "home_ownership", "is_default", replicates=200, seed=42)


@query("log_profile", "X8 H13", sql="WITH " + Q.FIRST_VISITS.strip() + """,
l AS (SELECT device_type, variant, ln(total_pageviews) AS v FROM first_visits),
a AS (SELECT device_type, variant, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max,
             avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, avg(v * v) AS m2r, avg(v * v * v) AS m3r,
             avg(v * v * v * v) AS m4r FROM l GROUP BY 1, 2),
b AS (SELECT *, m2r - mean * mean AS m2, m3r - 3 * mean * m2r + 2 * mean * mean * mean AS m3,
             m4r - 4 * mean * m3r + 6 * mean * mean * m2r - 3 * mean * mean * mean * mean AS m4 FROM a)
SELECT device_type, variant, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max,
       round(zero_share, 6) AS zero_share, round(m3 / NULLIF(pow(m2, 1.5), 0), 4) AS skewness,
       round(m4 / NULLIF(m2 * m2, 0), 4) AS kurtosis FROM b""")
def log_profile(spark, sf):
    from tessera.operators import htest
    fv = first_visits(spark, sf).withColumn("log_total_pageviews", X.ln("total_pageviews"))
    out = htest.distribution_profile(fv, "log_total_pageviews", ["device_type", "variant"])
    return out.select("device_type", "variant", "n",
                      *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max", "zero_share")],
                      *[F.round(c, 4).alias(c) for c in ("skewness", "kurtosis")])


@query("log_jitter_profile", "X8 H13")
def log_jitter_profile(spark, sf):
    """ln(x + U(0.01, 0.1)) of the zero-heavy metrics (seeded), profiled per cell."""
    from tessera.operators import htest
    fv = first_visits(spark, sf).withColumn("log_shopping", X.ln_jitter("shopping_pageviews", 7, key="user_id"))
    return htest.distribution_profile(fv, "log_shopping", ["device_type", "variant"])


def _doc_features(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = load(spark, sf, "labels")
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    lines = F.size(F.split(F.col("text"), "\n"))
    feats = (d.join(lab, "doc_id")
             .select("doc_id", "quality",
                     F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
                     F.log1p(words.cast("double")).alias("log_words"),
                     (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("chars_per_word"),
                     (words / F.greatest(lines, F.lit(1))).alias("words_per_line"),
                     (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.col("n_chars"), F.lit(1)))
                     .alias("digit_share"),
                     *[(F.col("lang") == lg).cast("double").alias(f"lang_{lg}") for lg in ("de", "en", "es", "fr")]))
    cols = ["log_chars", "log_words", "chars_per_word", "words_per_line", "digit_share",
            "lang_de", "lang_en", "lang_es", "lang_fr"]
    return feats, cols


def _score(spark, sf, kind):
    from tessera.session import materialize
    feats, cols = _doc_features(spark, sf)
    split = materialize(sampling.stratified_split(feats, "quality", "doc_id", 0.25, 42))
    train = split.where(F.col("split") == "train")
    n = train.count()
    stages = {"logistic": models.logistic(cols, "quality", n),
              "forest": models.forest_classifier(cols, "quality", 40, 20, max_depth=8),
              "gbt": models.gbt(cols, "quality", 100, 3)}[kind]
    m = models.fit_pipeline(train, stages)
    scored = models.with_score(m.transform(split)).select("doc_id", "split", "quality", "score")
    return evaluate.auc(scored, "quality", "score", "split").withColumn("model", F.lit(kind))


@query("score_logistic", "M6 M8 E5 R2")
def score_logistic(spark, sf):
    return _score(spark, sf, "logistic")


@query("score_forest", "M5 M8 E5 R2")
def score_forest(spark, sf):
    return _score(spark, sf, "forest")


@query("score_gbt", "M7 M8 E5 R2")
def score_gbt(spark, sf):
    return _score(spark, sf, "gbt")


@query("importances", "M9 M10 S7")
def importances(spark, sf):
    """Forest importances on the document features, then a refit on the top 3 (VectorSlicer-style selection)."""
    from tessera.session import materialize
    feats, cols = _doc_features(spark, sf)
    feats = materialize(feats)
    m = models.fit_pipeline(feats, models.forest_classifier(cols, "quality", 40, 20, max_depth=8))
    w = models.feature_weights(m, cols, "importance")
    top = models.top_features(w, 3)
    m2 = models.fit_pipeline(feats, models.forest_classifier(top, "quality", 40, 20, max_depth=8))
    a = evaluate.auc(models.with_score(m2.transform(feats)), "quality", "score").first()["auc"]
    return w.withColumn("selected", F.col("feature").isin(top)).withColumn("auc_top_features", F.lit(a))


@query("poisson_fit", "M11 N14", sql="WITH " + Q.FIRST_VISITS.strip() + """,
g AS (SELECT device_type, variant, ln(NULLIF(avg(shopping_pageviews), 0)) AS eta,
             1.0 / NULLIF(sum(shopping_pageviews), 0) AS inv FROM first_visits GROUP BY 1, 2),
s AS (SELECT device_type, count(*) AS k, CASE WHEN count(eta) = count(*) THEN avg(eta) END AS b0,
             CASE WHEN count(eta) = count(*) THEN sum(inv) END AS sinv FROM g GROUP BY 1),
r AS (SELECT g.*, s.k, s.b0, s.sinv, row_number() OVER (PARTITION BY g.device_type ORDER BY variant) AS j
      FROM g JOIN s USING (device_type))
SELECT device_type, '(Intercept)' AS term, round(b0, 8) AS estimate, round(sqrt(sinv / (k * k)), 8) AS std_err
FROM r WHERE j = 1
UNION ALL
SELECT device_type, 'group' || CAST(j AS VARCHAR), round(eta - b0, 8), round(sqrt((1 - 2.0 / k) * inv + sinv / (k * k)), 8)
FROM r WHERE j < k""")
def poisson_fit(spark, sf):
    from tessera.operators import counts
    out = counts.poisson_contrasts(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type")
    return out.select("device_type", "term", F.round("estimate", 8).alias("estimate"),
                      F.round("std_err", 8).alias("std_err"))


def _count_part(spark, sf, model):
    from tessera.operators import counts
    return counts.fit_count_models(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", (model,))


@query("zip_fit", "M12")
def zip_fit(spark, sf):
    return _count_part(spark, sf, "zip")


@query("zinb_fit", "M13")
def zinb_fit(spark, sf):
    return _count_part(spark, sf, "zinb")


@query("vuong", "M14")
def vuong(spark, sf):
    return _count_part(spark, sf, "vuong")


@query("factor_wald", "M15")
def factor_wald(spark, sf):
    return _count_part(spark, sf, "wald")


@query("holm", "H7 H8")
def holm(spark, sf):
    """Pairwise Mann-Whitney p-values per device with Holm's step-down adjustment."""
    from tessera.operators import htest
    mw = htest.mann_whitney(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type")
    return htest.holm(mw, "p_value", "device_type", tiebreak=["group_a", "group_b"])
