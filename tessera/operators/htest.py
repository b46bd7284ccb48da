"""Statistical tests as distributed aggregates.

Every test reduces the data to a few sufficient statistics per scope with
Spark aggregates, then applies a closed form. ``scope`` columns (for example
the device type) are outer keys, so one job tests every slice at once.
Statistic columns are plain Spark expressions; p-values are added by
``tessera.functions.dist`` on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dist
from tessera.operators._util import as_list, counted_side, pair_corr
from tessera.operators.rank import cumulative_counts, histogram_by, midranks


#: Pairs from which on the signed-rank test is approximated.
EXACT_BELOW = 50


def _div(a, b):
    return F.try_divide(a, b)


# ----------------------------------------------------------------- correlation

def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """Pearson r overall or per group (H1), with n, the rows where both are known; NULL where a
    column is constant there."""
    by = as_list(by)
    agg = [F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), pair_corr(x, y).alias("r")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def f_scores(df: DataFrame, y: str, features: Sequence[str], with_p: bool = True) -> DataFrame:
    """Univariate regression F-test per feature (H2, scikit-learn ``f_regression``):
    F = r^2 / (1 - r^2) * (n - 2), p from F(1, n - 2). One scan for all features; n counts the
    rows where the feature and the response are known."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.count_if(F.col(f).isNotNull() & F.col(y).isNotNull()).alias(f"__n{i}"), pair_corr(f, y).alias(f"__r{i}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.col(f"__n{i}").alias("n"), F.lit(f).alias("feature"), F.col(f"__r{i}").alias("r")) for i, f in enumerate(features)]
    out = wide.select(F.inline(F.array(*structs)))
    out = out.withColumn("f", _div(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")) * (F.col("n") - 2))
    if with_p:
        out = out.withColumn("p_value", dist.f_sf_col("f", 1.0, F.col("n") - 2))
    return out


# -------------------------------------------------------------- mean tests

def t_test(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """Two-sample t-test with pooled variance (H3). Groups ordered by label:
    t = mean(first) - mean(second) over its standard error. Rows without a group or
    a value are left out; other than two groups are an error."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                              F.var_samp(value).alias("v"))
    two = g.agg(F.sort_array(F.collect_list(F.struct(group, "n", "m", "v"))).alias("s"))
    two = two.select(F.when(F.size("s") == 2, F.col("s")).otherwise(
        F.raise_error(F.lit(f"t_test needs two groups in {group}"))).alias("s"))
    a, b = F.col("s")[0], F.col("s")[1]
    n1, n2 = a["n"], b["n"]
    sp2 = _div((n1 - 1) * a["v"] + (n2 - 1) * b["v"], n1 + n2 - 2)
    out = two.select(a[group].alias("group_a"), b[group].alias("group_b"), n1.alias("n_a"), n2.alias("n_b"),
                     a["m"].alias("mean_a"), b["m"].alias("mean_b"), F.sqrt(sp2).alias("sd_pooled"),
                     _div(a["m"] - b["m"], F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))).alias("t"),
                     (n1 + n2 - 2).alias("df"))
    if with_p:
        out = out.withColumn("p_value", dist.t_two_sided_col("t", "df"))
    return out


def _anova_of(z: DataFrame, scope: list[str], group: str, col: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    zc = F.col(col)
    gi = z.groupBy(*scope, group).agg(F.sum(F.when(zc.isNotNull(), w)).alias("__ni"), F.sum(w * zc).alias("__sz"),
                                      F.sum(w * zc * zc).alias("__szz"))
    gi = gi.withColumn("__zi", F.col("__sz") / F.col("__ni"))
    agg = [F.sum("__ni").cast("long").alias("N"), F.count(F.lit(1)).alias("k"),
           F.sum(F.col("__szz") - F.col("__sz") * F.col("__zi")).alias("__within"),
           F.sum(F.col("__ni") * F.col("__zi") * F.col("__zi")).alias("__s2"),
           F.sum(F.col("__sz")).alias("__s1")]
    tot = gi.groupBy(*scope).agg(*agg) if scope else gi.agg(*agg)
    between = F.col("__s2") - F.col("__s1") * F.col("__s1") / F.col("N")
    return tot.select(*scope, "N", "k",
                      _div((F.col("N") - F.col("k")) * between, (F.col("k") - 1) * F.col("__within")).alias("f"),
                      (F.col("k") - 1).alias("df1"), (F.col("N") - F.col("k")).alias("df2"))


def levene(df: DataFrame, group: str, value: str, scope: Sequence[str] | str | None = None,
           center: str = "mean", with_p: bool = True, weight: str | None = None) -> DataFrame:
    """Levene (``center='mean'``, H4) or Brown-Forsythe (``center='median'``, H5):
    one-way ANOVA on |x - centre of its group|. Centres are one row per group,
    joined back (bounded by the number of groups). ``weight``: frequency table."""
    scope = as_list(scope)
    keys = [*scope, group]
    x = F.col(value).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if center == "mean":
        c = df.where(x.isNotNull()).groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("__c"))
    else:
        from tessera.operators.rank import exact_quantiles
        c = exact_quantiles(df, value, [0.5], keys, weight=weight).select(*keys, F.col("q").alias("__c"))
    # one row per (scope, group): raw rows stay where they are
    z = df.join(counted_side(c), keys).withColumn("__z", F.abs(x - F.col("__c")))
    out = _anova_of(z, scope, group, "__z", weight)
    if with_p:
        out = out.withColumn("p_value", dist.f_sf_col("f", "df1", "df2"))
    return out


# -------------------------------------------------------------- rank tests

def kruskal(df: DataFrame, group: str, value: str, scope: Sequence[str] | str | None = None,
            with_p: bool = True, weight: str | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction, chi-square(k - 1) (H6).
    ``weight``: ``df`` is a frequency table with that count column."""
    scope = as_list(scope)
    hist = histogram_by(df, scope, group, value, weight)
    ranked, _ = midranks(hist, scope, bounds=(df, value))
    per_g = ranked.groupBy(*scope, group).agg(F.sum("__n").alias("__ni"),
                                              F.sum(F.col("__n") * F.col("midrank")).alias("__Ri"),
                                              F.sum(_tie_share()).alias("__Ti"))
    agg = [F.sum("__ni").alias("N"), F.count(F.lit(1)).alias("k"),
           F.sum(F.col("__Ri") * F.col("__Ri") / F.col("__ni")).alias("__S"), F.sum("__Ti").alias("__T")]
    j = per_g.groupBy(*scope).agg(*agg) if scope else per_g.agg(*agg)
    n = F.col("N").cast("double")
    h_raw = 12.0 / (n * (n + 1)) * F.col("__S") - 3 * (n + 1)
    corr = 1 - _div(F.col("__T"), n * n * n - n)
    out = j.select(*scope, "N", "k", _div(h_raw, corr).alias("h"), (F.col("k") - 1).alias("df"))
    if with_p:
        out = out.withColumn("p_value", dist.chi2_sf_col("h", "df"))
    return out


def _tie_share():
    """Each histogram row's share of its value's tie term t^3 - t: summing it over
    the rows of a scope counts every distinct value once (n / t of it per row),
    so the tie correction needs no separate aggregate or join."""
    t = F.col("__t").cast("double")
    return F.col("__n") / t * (t * t * t - t)


def _pairs(groups: DataFrame, scope: list[str], group: str) -> DataFrame:
    """(scope, group_a, group_b) with group_a < group_b for every pair of groups
    of a scope. Built from the sorted list of group labels per scope (one
    short array: a test compares a handful of groups), so no join is needed."""
    per = (groups.groupBy(*scope) if scope else groups).agg(F.sort_array(F.collect_set(group)).alias("__gs"))
    gs = F.col("__gs")
    pairs = F.flatten(F.transform(gs, lambda a, i: F.transform(
        F.slice(gs, i + 2, F.greatest(F.size(gs) - i - 1, F.lit(0))),
        lambda b: F.struct(a.alias("group_a"), b.alias("group_b")))))
    return per.select(*scope, F.explode(pairs).alias("__p")).select(*scope, "__p.group_a", "__p.group_b")


def mann_whitney(df: DataFrame, group: str, value: str, scope: Sequence[str] | str | None = None,
                 with_p: bool = True, weight: str | None = None) -> DataFrame:
    """Pairwise Mann-Whitney U with normal approximation and continuity
    correction (H7, R ``wilcox.test(exact=FALSE)``); W is the rank sum of
    ``group_a`` minus n_a(n_a+1)/2. Ranks are recomputed within each pair."""
    scope = as_list(scope)
    hist = histogram_by(df, scope, group, value, weight)
    groups = hist.select(*scope, group).distinct()
    pairs = _pairs(groups, scope, group).select(*[F.col(c).alias(f"__p_{c}") for c in scope],
                                                 "group_a", "group_b")
    on = [F.col(c) == F.col(f"__p_{c}") for c in scope]
    in_a = hist.join(pairs, on + [F.col(group) == F.col("group_a")])
    in_b = hist.join(pairs, on + [F.col(group) == F.col("group_b")])
    cols = [*scope, "group_a", "group_b", F.col(group).alias("__g"), "__v", "__n"]
    ph = in_a.select(*cols).unionByName(in_b.select(*cols))
    pscope = [*scope, "group_a", "group_b"]
    ranked, _ = midranks(ph, pscope, bounds=(df, value))
    j = ranked.groupBy(*pscope).agg(
        F.sum(F.when(F.col("__g") == F.col("group_a"), F.col("__n"))).alias("n_a"),
        F.sum(F.when(F.col("__g") == F.col("group_b"), F.col("__n"))).alias("n_b"),
        F.sum(F.when(F.col("__g") == F.col("group_a"), F.col("__n") * F.col("midrank"))).alias("__Ra"),
        F.sum("__n").alias("__N"), F.sum(_tie_share()).alias("__T"))
    na, nb, N = (F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("__N").cast("double"))
    w = F.col("__Ra") - na * (na + 1) / 2
    d = w - na * nb / 2
    sigma = F.sqrt(na * nb / 12 * ((N + 1) - _div(F.col("__T"), N * (N - 1))))
    out = j.select(*pscope, "n_a", "n_b", w.alias("w"), _div(d - F.signum(d) * 0.5, sigma).alias("z"))
    if with_p:
        out = out.withColumn("p_value", dist.norm_two_sided_col("z"))
    return out


def conover(df: DataFrame, group: str, value: str, scope: Sequence[str] | str | None = None,
            with_p: bool = True, adjust: str | None = "holm", weight: str | None = None) -> DataFrame:
    """Conover-Iman pairwise comparisons after Kruskal-Wallis (H9), ranks over
    all groups of the scope, t with N - k degrees of freedom; Holm-adjusted."""
    scope = as_list(scope)
    hist = histogram_by(df, scope, group, value, weight)
    ranked, _ = midranks(hist, scope, bounds=(df, value))
    per_g = ranked.groupBy(*scope, group).agg(
        F.sum("__n").alias("__ni"), F.sum(F.col("__n") * F.col("midrank")).alias("__Ri"),
        F.sum(F.col("__n") * F.col("midrank") * F.col("midrank")).alias("__R2i"), F.sum(_tie_share()).alias("__Ti"))
    # scope totals as windows over the per-group rows (one row per group of the
    # scope), so every pair row carries them without another aggregate or join
    w = Window.partitionBy(*scope)
    pg = per_g.select(*scope, group, "__ni", "__Ri",
                      F.sum("__ni").over(w).alias("N"), F.count(F.lit(1)).over(w).alias("k"),
                      F.sum(F.col("__Ri") * F.col("__Ri") / F.col("__ni")).over(w).alias("__S"),
                      F.sum("__R2i").over(w).alias("__R2"), F.sum("__Ti").over(w).alias("__T"))
    n = F.col("N").cast("double")
    h = _div(12.0 / (n * (n + 1)) * F.col("__S") - 3 * (n + 1), 1 - _div(F.col("__T"), n * n * n - n))
    s2 = _div(F.col("__R2") - n * (n + 1) * (n + 1) / 4, n - 1)
    ga = pg.select(*scope, F.col(group).alias("group_a"), F.col("__ni").alias("n_a"),
                   (F.col("__Ri") / F.col("__ni")).alias("__rbar_a"), "N", "k", h.alias("__h"), s2.alias("__s2"))
    gb = pg.select(*scope, F.col(group).alias("group_b"), F.col("__ni").alias("n_b"),
                   (F.col("__Ri") / F.col("__ni")).alias("__rbar_b"))
    pr = _pairs(per_g.select(*scope, group), scope, group).join(ga, [*scope, "group_a"]).join(gb, [*scope, "group_b"])
    denom = F.sqrt(_div(F.col("__s2") * (n - 1 - F.col("__h")), n - F.col("k"))
                   * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    out = pr.select(*scope, "group_a", "group_b", "n_a", "n_b",
                    _div(F.abs(F.col("__rbar_a") - F.col("__rbar_b")), denom).alias("t"),
                    (F.col("N") - F.col("k")).alias("df"))
    if with_p:
        out = out.withColumn("p_value", dist.t_two_sided_col("t", "df"))
        if adjust == "holm":
            out = holm(out, "p_value", scope, out_col="p_adjusted")
    return out


def holm(df: DataFrame, p: str, family: Sequence[str] | str | None = None,
         out_col: str = "p_holm", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Holm step-down adjustment within each family (H8):
    p~(i) = min(1, max_{j <= i} (m - j + 1) p(j)). Families are the handful of
    comparisons of one test, so the window is small."""
    family = as_list(family)
    order = [F.col(p)] + [F.col(c) for c in (tiebreak or [])]
    w = Window.partitionBy(*family).orderBy(*order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    step = df.withColumn("__raw", raw)
    run = F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(out_col, F.least(F.lit(1.0), run)).drop("__raw")


def signed_rank(df: DataFrame, x: str, y: str, scope: Sequence[str] | str | None = None,
                with_p: bool = True, weight: str | None = None) -> DataFrame:
    """Paired Wilcoxon signed-rank test, zero differences dropped (H10): the exact distribution for
    fewer than ``EXACT_BELOW`` pairs without ties or zeros (``exact``), else the normal approximation
    with tie and continuity correction. ``weight``: ``df`` is a frequency table of (x, y) pairs."""
    scope = as_list(scope)
    d = (F.col(x) - F.col(y)).cast("double")
    w = F.col(weight) if weight else F.lit(1)
    known = df.select(*scope, d.alias("__d"), w.alias("__w")).where(F.col("__d").isNotNull())
    base = known.where(F.col("__d") != 0)
    hist = (base.groupBy(*scope, F.abs("__d").alias("__v"), (F.col("__d") > 0).alias("__pos"))
            .agg(F.sum("__w").cast("long").alias("__n")))
    # pairs without a difference: one more row of no rank, so that they are counted with the others
    none = known.where(F.col("__d") == 0).groupBy(*scope).agg(F.sum("__w").cast("long").alias("__zeros"))
    ranked, _ = midranks(hist, scope, bounds=(base, F.abs("__d")))
    ranked = ranked.withColumn("__zeros", F.lit(0).cast("long")).unionByName(none, allowMissingColumns=True)
    agg = [F.sum("__zeros").alias("__zeros"),
           F.sum(F.when(F.col("__pos"), F.col("__n") * F.col("midrank")).otherwise(0.0)).alias("v_stat"),
           F.sum("__n").alias("__N"), F.coalesce(F.sum(_tie_share()), F.lit(0.0)).alias("__T")]
    j = (ranked.groupBy(*scope).agg(*agg) if scope else ranked.agg(*agg)).where(F.col("__N").isNotNull())
    n = F.col("__N").cast("double")
    zc = F.col("v_stat") - n * (n + 1) / 4
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__T") / 48)
    exact = (F.col("__N") < EXACT_BELOW) & (F.col("__T") == 0) & (F.col("__zeros") == 0)
    out = j.select(*scope, F.col("__N").alias("n"), "v_stat", _div(zc - F.signum(zc) * 0.5, sigma).alias("z"), exact.alias("exact"))
    if not with_p:
        return out.drop("exact")
    out = out.withColumn("__normal", dist.norm_two_sided_col("z"))
    return out.withColumn("p_value", F.when(F.col("exact"), _signed_rank_p(F.col("n"), F.col("v_stat"))).otherwise(F.col("__normal"))).drop("__normal")


def _signed_rank_p(n, v):
    """Two-sided p-value from the distribution of the sum of positive ranks under no difference: how
    many subsets of 1..n have each sum, by adding one rank at a time to an array of counts
    (whole numbers in doubles, exact below 2^53)."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    step = lambda c, i: F.zip_with(F.concat(c, zeros(i)), F.concat(zeros(i), c), lambda a, b: a + b)
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), step)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    whole, at = add(counts), F.floor(v).cast("int")
    below, above = add(F.slice(counts, 1, at + 1)), add(F.slice(counts, at + 1, F.size(counts) - at))
    return F.least(F.lit(1.0), 2 * F.least(below, above) / whole)


# -------------------------------------------------------------- normality

def residual_moments(df: DataFrame, y: str, factor: str | None, scope: Sequence[str] | str | None = None,
                     with_p: bool = True, weight: str | None = None) -> DataFrame:
    """Residuals of ``y ~ factor`` (y minus its group mean): skewness, kurtosis
    (plain, normal = 3) and the Jarque-Bera statistic (H11). ``weight``:
    frequency table."""
    scope = as_list(scope)
    keys = [*scope] + ([factor] if factor else [])
    yy = F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.where(yy.isNotNull())
    m = (base.groupBy(*keys) if keys else base).agg((F.sum(w * yy) / F.sum(w)).alias("__m"))
    from tessera.operators._util import attach_scalars
    r = (base.join(counted_side(m), keys) if keys else attach_scalars(base, m)).withColumn("__e", yy - F.col("__m"))
    e = F.col("__e")
    sw = F.sum(w)
    agg = [sw.cast("long").alias("n"), (F.sum(w * e * e) / sw).alias("m2"), (F.sum(w * e * e * e) / sw).alias("m3"),
           (F.sum(w * e * e * e * e) / sw).alias("m4")]
    mom = r.groupBy(*scope).agg(*agg) if scope else r.agg(*agg)
    skew = _div(F.col("m3"), F.pow(F.col("m2"), 1.5))
    kurt = _div(F.col("m4"), F.col("m2") * F.col("m2"))
    out = mom.select(*scope, "n", skew.alias("skewness"), kurt.alias("kurtosis"))
    out = out.withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness")
                                                             + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4))
    if with_p:
        out = out.withColumn("p_value", dist.chi2_sf_col("jarque_bera", 2.0))
    return out


def residual_ks(df: DataFrame, y: str, factor: str | None, scope: Sequence[str] | str | None = None) -> DataFrame:
    """Kolmogorov-Smirnov test of the residuals of ``y ~ factor`` against a normal distribution with
    their own mean and sd (H11): n, the largest distance between the two distribution functions
    and its p-value (asymptotic Kolmogorov distribution with Stephens' correction for n).

    One plan for all scopes: residuals are counted by value, cumulative counts give the empirical
    function before and after each value, and the supremum is one maximum per scope. A NULL scope
    is a scope like any other; without spread the statistic is NULL.
    """
    from tessera.operators._util import attach_scalars

    scope = as_list(scope)
    keys = [*scope] + ([factor] if factor else [])
    yy = F.col(y).cast("double")
    # a name of its own for each scope, so that NULL scopes meet in joins
    name = F.to_json(F.struct(*[F.col(c) for c in scope])) if scope else F.lit("all")
    cell = F.to_json(F.struct(*[F.col(c) for c in keys])) if keys else F.lit("all")
    base = df.where(yy.isNotNull()).select(*scope, name.alias("__s"), cell.alias("__c"), yy.alias("__y"))
    m = base.groupBy("__c").agg(F.avg("__y").alias("__m"))
    e = base.join(counted_side(m), "__c").select(*scope, "__s", (F.col("__y") - F.col("__m")).alias("__e"))
    ties = e.groupBy("__s", "__e").agg(F.count(F.lit(1)).alias("__n"))
    whole = e.groupBy("__s", *scope).agg(F.count(F.lit(1)).alias("n"), F.avg("__e").alias("__mu"), F.stddev_samp("__e").alias("__sd"))
    ranked = cumulative_counts(ties, ["__s"], "__e", "__n", out="__below", bounds=(e, "__e"))
    z = ranked.join(counted_side(whole), "__s").where(F.col("__sd") > 0)
    p = dist.norm_cdf_col((F.col("__e") - F.col("__mu")) / F.col("__sd"))
    far = z.withColumn("__p", p).select("__s", F.greatest(
        F.abs(F.col("__p") - F.col("__below") / F.col("n")),
        F.abs(F.col("__p") - (F.col("__below") + F.col("__n")) / F.col("n"))).alias("__d"))
    most = far.groupBy("__s").agg(F.max("__d").alias("ks_statistic"))
    out = whole.join(most, "__s", "left").select(*scope, "n", "ks_statistic")
    root = F.sqrt(F.col("n").cast("double"))
    lam = F.col("ks_statistic") * (root + 0.12 + 0.11 / root)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, k: t + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(-2.0 * k * k * lam * lam))
    return out.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms))))


def qq_points(df: DataFrame, value: str, n_points: int = 99, scope: Sequence[str] | str | None = None,
              theoretical: bool = True) -> DataFrame:
    """Sample quantiles at p_i = (i - 0.5) / n_points against normal quantiles.
    Exact quantiles come from the distributed rank machinery."""
    from tessera.operators.rank import exact_quantiles
    probs = [(i - 0.5) / n_points for i in range(1, n_points + 1)]
    out = exact_quantiles(df, value, probs, scope).withColumnRenamed("q", "sample_q")
    if theoretical:
        out = out.withColumn("normal_q", dist.norm_ppf_col("p"))
    return out


def distribution_profile(df: DataFrame, value: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """Moments and zero share of a metric (H13, the numbers behind the metric plots)."""
    by = as_list(by)
    v = F.col(value).cast("double")
    agg = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
           F.min(v).alias("min"), F.max(v).alias("max"),
           F.avg((v == 0).cast("double")).alias("zero_share"),
           F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis")]
    out = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    return out.select(*by, "n", "mean", "sd", "min", "max", "zero_share", "skewness", "kurtosis")
