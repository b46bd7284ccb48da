"""Named queries: ranks, statistical tests and distribution tables.

The SQL-checked versions carry the test statistics; p-values (which need
distribution functions DuckDB lacks) are checked by unit tests against
published table values and appear in the ``ab_report`` study.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import htest, summary
from tessera.operators.rank import exact_quantiles
from tessera.plans import sqlparts as Q
from tessera.plans.catalog_basic import first_visits
from tessera.plans.registry import query
from tessera.sources import standins as S
from tessera.sources.tables import load


def _r(df, digits: int, cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_FV = "WITH " + Q.FIRST_VISITS.strip() + ",\nx AS (SELECT device_type AS s, variant AS g, CAST(shopping_pageviews AS DOUBLE) AS v FROM first_visits)"

_KW_TAIL = """,
r AS (SELECT s, g, v, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS mr FROM x),
pg AS (SELECT s, g, count(*) AS ni, sum(mr) AS ri FROM r GROUP BY s, g),
ps AS (SELECT s, CAST(sum(ni) AS DOUBLE) AS nn, count(*) AS k, sum(ri * ri / ni) AS ss FROM pg GROUP BY s),
tt AS (SELECT s, sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT s, v, count(*) AS c FROM x GROUP BY s, v) GROUP BY s)
SELECT {sel} CAST(nn AS BIGINT) AS "N", k,
       round((12.0 / (nn * (nn + 1)) * ss - 3 * (nn + 1)) / NULLIF(1 - tt / (nn * nn * nn - nn), 0), 6) AS h, k - 1 AS df
FROM ps JOIN tt USING (s)"""


@query("kruskal", "W3 H6", sql=_FV + _KW_TAIL.format(sel="s AS device_type,"))
def kruskal(spark, sf):
    out = htest.kruskal(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", with_p=False)
    return _r(out, 6, {"h"})


@query("kruskal_lineitem", "W3 H6", sql="""WITH x AS (SELECT 1 AS s, l_returnflag AS g, l_quantity AS v FROM lineitem)"""
       + _KW_TAIL.format(sel=""))
def kruskal_lineitem(spark, sf):
    out = htest.kruskal(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", with_p=False)
    return _r(out, 6, {"h"})


_MW_SQL = _FV + """,
gs AS (SELECT DISTINCT s, g FROM x),
pairs AS (SELECT a.s, a.g AS ga, b.g AS gb FROM gs a JOIN gs b ON a.s = b.s AND a.g < b.g),
px AS (SELECT p.s, p.ga, p.gb, x.g, x.v FROM pairs p JOIN x ON x.s = p.s AND (x.g = p.ga OR x.g = p.gb)),
r AS (SELECT *, rank() OVER (PARTITION BY s, ga, gb ORDER BY v)
                + (count(*) OVER (PARTITION BY s, ga, gb, v) - 1) / 2.0 AS mr FROM px),
ag AS (SELECT s, ga, gb, CAST(count_if(g = ga) AS DOUBLE) AS na, CAST(count_if(g = gb) AS DOUBLE) AS nb,
              sum(CASE WHEN g = ga THEN mr END) AS ra FROM r GROUP BY 1, 2, 3),
tt AS (SELECT s, ga, gb, sum(CAST(c AS DOUBLE) * c * c - c) AS tt, CAST(sum(c) AS DOUBLE) AS nn
       FROM (SELECT s, ga, gb, v, count(*) AS c FROM px GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
w AS (SELECT *, ra - na * (na + 1) / 2 AS w FROM ag JOIN tt USING (s, ga, gb))
SELECT s AS device_type, ga AS group_a, gb AS group_b, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b,
       round(w, 6) AS w,
       round(((w - na * nb / 2) - sign(w - na * nb / 2) * 0.5)
             / NULLIF(sqrt(na * nb / 12 * ((nn + 1) - tt / (nn * (nn - 1)))), 0), 6) AS z
FROM w"""


@query("mann_whitney", "W3 H7", sql=_MW_SQL)
def mann_whitney(spark, sf):
    out = htest.mann_whitney(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", with_p=False)
    return _r(out, 6, {"w", "z"})


_CON_SQL = _FV + """,
r AS (SELECT s, g, v, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS mr FROM x),
pg AS (SELECT s, g, count(*) AS ni, sum(mr) AS ri, sum(mr * mr) AS r2 FROM r GROUP BY s, g),
ps AS (SELECT s, CAST(sum(ni) AS DOUBLE) AS nn, count(*) AS k, sum(ri * ri / ni) AS ss, sum(r2) AS r2 FROM pg GROUP BY s),
tt AS (SELECT s, sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT s, v, count(*) AS c FROM x GROUP BY s, v) GROUP BY s),
st AS (SELECT s, nn, k, (12.0 / (nn * (nn + 1)) * ss - 3 * (nn + 1)) / NULLIF(1 - tt / (nn * nn * nn - nn), 0) AS h,
              (r2 - nn * (nn + 1) * (nn + 1) / 4) / (nn - 1) AS s2 FROM ps JOIN tt USING (s))
SELECT a.s AS device_type, a.g AS group_a, b.g AS group_b, a.ni AS n_a, b.ni AS n_b,
       round(abs(a.ri / a.ni - b.ri / b.ni)
             / NULLIF(sqrt(s2 * (nn - 1 - h) / (nn - k) * (1.0 / a.ni + 1.0 / b.ni)), 0), 6) AS t,
       CAST(nn - k AS BIGINT) AS df
FROM pg a JOIN pg b ON a.s = b.s AND a.g < b.g JOIN st ON st.s = a.s"""


@query("conover", "W3 H9", sql=_CON_SQL)
def conover(spark, sf):
    out = htest.conover(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", with_p=False)
    return _r(out, 6, {"t"})


@query("signed_rank", "W3 H10", sql="WITH " + Q.FIRST_VISITS.strip() + """,
x AS (SELECT device_type AS s, CAST(bottom_related_link_clicks - top_related_link_clicks AS DOUBLE) AS d
      FROM first_visits WHERE variant = 'top_and_bottom'),
nz AS (SELECT s, d, abs(d) AS a FROM x WHERE d <> 0),
r AS (SELECT s, d, rank() OVER (PARTITION BY s ORDER BY a) + (count(*) OVER (PARTITION BY s, a) - 1) / 2.0 AS mr FROM nz),
v AS (SELECT s, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN mr ELSE 0 END) AS vs FROM r GROUP BY s),
tt AS (SELECT s, sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT s, a, count(*) AS c FROM nz GROUP BY 1, 2) GROUP BY s)
SELECT s AS device_type, CAST(n AS BIGINT) AS n, round(vs, 6) AS v_stat,
       round(((vs - n * (n + 1) / 4) - sign(vs - n * (n + 1) / 4) * 0.5)
             / NULLIF(sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48), 0), 6) AS z
FROM v JOIN tt USING (s)""")
def signed_rank(spark, sf):
    fv = first_visits(spark, sf).where(F.col("variant") == "top_and_bottom")
    out = htest.signed_rank(fv, "bottom_related_link_clicks", "top_related_link_clicks", "device_type", with_p=False)
    return _r(out, 6, {"v_stat", "z"})


def _levene_sql(center: str) -> str:
    c = "avg(v)" if center == "mean" else "quantile_cont(v, 0.5)"
    return _FV + f""",
c AS (SELECT s, g, {c} AS c FROM x GROUP BY 1, 2),
z AS (SELECT x.s, x.g, abs(x.v - c.c) AS z FROM x JOIN c USING (s, g)),
gi AS (SELECT s, g, count(*) AS ni, avg(z) AS zi, coalesce(var_samp(z) * (count(*) - 1), 0) AS ssin FROM z GROUP BY 1, 2),
tot AS (SELECT s, CAST(sum(ni) AS DOUBLE) AS nn, count(*) AS k, sum(ssin) AS within,
               sum(ni * zi * zi) AS s2, sum(ni * zi) AS s1 FROM gi GROUP BY s)
SELECT s AS device_type, CAST(nn AS BIGINT) AS "N", k,
       round((nn - k) * (s2 - s1 * s1 / nn) / NULLIF((k - 1) * within, 0), 6) AS f,
       k - 1 AS df1, CAST(nn - k AS BIGINT) AS df2 FROM tot"""


@query("levene", "H4", sql=_levene_sql("mean"))
def levene(spark, sf):
    out = htest.levene(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", "mean", with_p=False)
    return _r(out, 6, {"f"})


@query("brown_forsythe", "H5", sql=_levene_sql("median"))
def brown_forsythe(spark, sf):
    out = htest.levene(first_visits(spark, sf), "variant", "shopping_pageviews", "device_type", "median", with_p=False)
    return _r(out, 6, {"f"})


@query("t_test", "H3", sql="WITH " + Q.DOGS.strip() + """,
g AS (SELECT gender, count(weight) AS n, avg(weight) AS m, var_samp(weight) AS v FROM dogs GROUP BY gender),
a AS (SELECT * FROM g ORDER BY gender LIMIT 1),
b AS (SELECT * FROM g ORDER BY gender LIMIT 1 OFFSET 1),
j AS (SELECT a.gender AS ga, b.gender AS gb, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb,
             ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS sp2 FROM a, b)
SELECT ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
       round(sqrt(sp2), 6) AS sd_pooled, round((ma - mb) / sqrt(sp2 * (1.0 / na + 1.0 / nb)), 6) AS t,
       na + nb - 2 AS df FROM j""")
def t_test(spark, sf):
    out = htest.t_test(S.dogs(spark, sf), "gender", "weight", with_p=False)
    return _r(out, 6, {"mean_a", "mean_b", "sd_pooled", "t"})


_F_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("f_scores", "H2", sql="\nUNION ALL\n".join(
    f"SELECT count(*) AS n, '{f}' AS feature, round(corr({f}, l_extendedprice), 8) AS r, "
    f"round(corr({f}, l_extendedprice) * corr({f}, l_extendedprice) / (1 - corr({f}, l_extendedprice) * "
    f"corr({f}, l_extendedprice)) * (count(*) - 2), 4) AS f FROM lineitem" for f in _F_FEATURES))
def f_scores(spark, sf):
    out = htest.f_scores(load(spark, sf, "lineitem"), "l_extendedprice", _F_FEATURES, with_p=False)
    return out.select("n", "feature", F.round("r", 8).alias("r"), F.round("f", 4).alias("f"))


@query("residual_normality", "H11", sql="WITH " + Q.FIRST_VISITS.strip() + """,
m AS (SELECT device_type, variant, avg(ln(total_pageviews)) AS m FROM first_visits GROUP BY 1, 2),
e AS (SELECT f.device_type, ln(f.total_pageviews) - m.m AS e FROM first_visits f JOIN m USING (device_type, variant)),
mo AS (SELECT device_type, count(e) AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM e GROUP BY 1)
SELECT device_type, n, round(m3 / NULLIF(pow(m2, 1.5), 0), 6) AS skewness, round(m4 / NULLIF(m2 * m2, 0), 6) AS kurtosis,
       round(n / 6.0 * (pow(m3 / NULLIF(pow(m2, 1.5), 0), 2) + pow(m4 / NULLIF(m2 * m2, 0) - 3, 2) / 4), 6) AS jarque_bera
FROM mo""")
def residual_normality(spark, sf):
    fv = first_visits(spark, sf).withColumn("log_total_pageviews", F.log("total_pageviews"))
    out = htest.residual_moments(fv, "log_total_pageviews", "variant", "device_type", with_p=False)
    return _r(out, 6, {"skewness", "kurtosis", "jarque_bera"})


_QQ_P = [(i - 0.5) / 10 for i in range(1, 11)]


@query("qq_points", "H12", sql="\nUNION ALL\n".join(
    f"SELECT CAST({p!r} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice, {p!r}), 4) AS sample_q FROM lineitem"
    for p in _QQ_P))
def qq_points(spark, sf):
    out = htest.qq_points(load(spark, sf, "lineitem"), "l_extendedprice", 10, theoretical=False)
    return out.select("p", F.round("sample_q", 4).alias("sample_q"))


@query("exact_quantiles", "W3 P9", sql="\nUNION ALL\n".join(
    f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_quantity, {p}), 6) AS q "
    f"FROM lineitem GROUP BY l_returnflag" for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def exact_quantiles_q(spark, sf):
    out = exact_quantiles(load(spark, sf, "lineitem"), "l_quantity", [0.1, 0.25, 0.5, 0.75, 0.9], "l_returnflag")
    return out.withColumn("q", F.round("q", 6))


@query("pearson", "H1", sql="WITH " + Q.DOGS.strip() + """
SELECT 'all' AS gender, count(*) AS n, round(corr(height, weight), 8) AS r FROM dogs
UNION ALL SELECT gender, count(*), round(corr(height, weight), 8) FROM dogs GROUP BY gender""")
def pearson(spark, sf):
    d = S.dogs(spark, sf)
    overall = htest.pearson(d, "height", "weight").select(F.lit("all").alias("gender"), "n", "r")
    out = overall.unionByName(htest.pearson(d, "height", "weight", "gender"))
    return out.withColumn("r", F.round("r", 8))


@query("regression_line", "D4h H1", sql="WITH " + Q.DOGS.strip() + """
SELECT gender, count(*) AS n, round(regr_slope(weight, height), 8) AS slope,
       round(regr_intercept(weight, height), 6) AS intercept, round(regr_r2(weight, height), 8) AS r2,
       round(corr(height, weight), 8) AS r FROM dogs GROUP BY gender""")
def regression_line(spark, sf):
    out = summary.regression_lines(S.dogs(spark, sf), "height", "weight", "gender")
    return out.select("gender", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"),
                      F.round("r2", 8).alias("r2"), F.round("r", 8).alias("r"))


@query("histogram", "D1h", sql="""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(19, floor((o_totalprice - lo) / (hi - lo) * 20)) END AS BIGINT) AS bin,
             lo, hi FROM orders, r)
SELECT bin, round(lo + bin * (hi - lo) / 20, 4) AS low, round(lo + (bin + 1) * (hi - lo) / 20, 4) AS high,
       count(*) AS n FROM b GROUP BY bin, lo, hi""")
def histogram(spark, sf):
    out = summary.histogram(load(spark, sf, "orders"), "o_totalprice", 20)
    return out.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("box_summary", "D3h", sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT l.l_returnflag, l_extendedprice AS v, q1, median, q3,
             l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem l JOIN q USING (l_returnflag))
SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(CASE WHEN inside THEN v END), 4) AS whisker_low, round(max(CASE WHEN inside THEN v END), 4) AS whisker_high,
       CAST(count_if(NOT inside) AS BIGINT) AS n_outliers, count(v) AS n
FROM j GROUP BY l_returnflag, q1, median, q3""")
def box_summary(spark, sf):
    out = summary.box_summary(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return _r(out, 4, {"q1", "median", "q3", "whisker_low", "whisker_high"})


@query("distribution_profile", "H13 X8", sql="WITH " + Q.FIRST_VISITS.strip() + """,
a AS (SELECT device_type, variant, count(*) AS n, avg(CAST(shopping_pageviews AS DOUBLE)) AS mean,
             stddev_samp(shopping_pageviews) AS sd, CAST(min(shopping_pageviews) AS DOUBLE) AS min,
             CAST(max(shopping_pageviews) AS DOUBLE) AS max,
             avg(CASE WHEN shopping_pageviews = 0 THEN 1.0 ELSE 0.0 END) AS zero_share,
             avg(pow(shopping_pageviews, 2)) AS m2r, avg(pow(shopping_pageviews, 3)) AS m3r,
             avg(pow(shopping_pageviews, 4)) AS m4r FROM first_visits GROUP BY 1, 2),
b AS (SELECT *, m2r - mean * mean AS m2, m3r - 3 * mean * m2r + 2 * mean * mean * mean AS m3,
             m4r - 4 * mean * m3r + 6 * mean * mean * m2r - 3 * mean * mean * mean * mean AS m4 FROM a)
SELECT device_type, variant, n, round(mean, 6) AS mean, round(sd, 6) AS sd, min, max, round(zero_share, 6) AS zero_share,
       round(m3 / NULLIF(pow(m2, 1.5), 0), 6) AS skewness, round(m4 / NULLIF(m2 * m2, 0), 6) AS kurtosis FROM b""")
def distribution_profile(spark, sf):
    out = htest.distribution_profile(first_visits(spark, sf), "shopping_pageviews", ["device_type", "variant"])
    return _r(out, 6, {"mean", "sd", "zero_share", "skewness", "kurtosis"})


@query("kde", "D2h", sql="""
WITH st AS (SELECT count(o_totalprice) AS n, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo,
                   max(o_totalprice) AS hi FROM orders),
s2 AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 63 AS step FROM st),
e AS (SELECT g.g, lo + g.g * step AS x, n, h, o_totalprice AS v FROM orders, s2, range(64) AS g(g))
SELECT CAST(g AS INTEGER) AS point, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (n * h * 2.5066282746310002)) * 1e6, 6) AS density_per_million
FROM e GROUP BY g, x""")
def kde(spark, sf):
    out = summary.kde(load(spark, sf, "orders"), "o_totalprice", grid=64)
    return out.select("point", F.round("x", 6).alias("x"),
                      F.round(F.col("density") * 1e6, 6).alias("density_per_million"))


@query("residual_ks", "H11")
def residual_ks(spark, sf):
    fv = first_visits(spark, sf).withColumn("log_total_pageviews", F.log("total_pageviews"))
    return htest.residual_ks(fv, "log_total_pageviews", "variant", "device_type")
