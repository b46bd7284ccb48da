"""Count-data models for one categorical factor (M11-M15): Poisson,
zero-inflated Poisson, zero-inflated negative binomial, Vuong tests and a
Wald test of the factor under sum-to-zero contrasts.

With one factor the table (scope, group, y, n) is a sufficient statistic, built by one distributed
aggregate (partial aggregation absorbs a hot group) and independent of the number of rows. All
fits are Spark expressions and aggregates over it:

* Poisson: mu_g = group mean.
* ZIP: P(Y > 0) = n_pos / n and lambda / (1 - exp(-lambda)) = mean of positives.
* ZINB with shared theta: for fixed theta, P(Y > 0) = n_pos / n and the truncated
  negative-binomial mean mu / (1 - p0) equals the mean of positives; theta
  maximises the profile likelihood over grids that are refined about the best point.

Standard errors come from the observed information, in closed form: a 2 x 2 block per group,
linked by theta alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dist
from tessera.operators._util import as_list
from tessera.session import materialize


def count_table(df: DataFrame, group: str, y: str, scope: Sequence[str] | str | None = None) -> DataFrame:
    """(scope, group, y, n): rows per observed count."""
    scope = as_list(scope)
    return (df.where(F.col(y).isNotNull())
            .groupBy(*scope, F.col(group).alias("group"), F.col(y).cast("long").alias("y"))
            .agg(F.count(F.lit(1)).alias("n")))


def poisson_means(df: DataFrame, group: str, y: str, scope: Sequence[str] | str | None = None) -> DataFrame:
    """Poisson GLM with a factor (M11): fitted mean per group (the group mean),
    linear predictor eta = log(mean) and its standard error 1/sqrt(sum y)."""
    scope = as_list(scope)
    g = df.groupBy(*scope, F.col(group).alias("group")).agg(
        F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    return (g.withColumn("mean", F.try_divide(F.col("total"), F.col("n")))
            .withColumn("eta", F.log("mean"))
            .withColumn("se_eta", F.try_divide(F.lit(1.0), F.sqrt("total"))))


# ------------------------------------------------------------------ likelihoods

def _log_factorial(y: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(y, F.lit(1))), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))


def _rising(y: Column, theta: Column) -> Column:
    """log of gamma(y + theta) / (gamma(theta) y!): a sum of y terms."""
    return F.when(y > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(y, F.lit(1)) - 1), F.lit(0.0),
                                     lambda s, k: s + F.log((theta + k) / (k + 1)))).otherwise(0.0)


def _log_zero(mu: Column, theta: Column | None) -> Column:
    """log P(0) of a Poisson (no ``theta``) or a negative binomial count."""
    return -mu if theta is None else theta * F.log(theta / (theta + mu))


def _log_count(y: Column, mu: Column, theta: Column | None) -> Column:
    if theta is None:
        return y * F.log(mu) - mu - _log_factorial(y)
    return _rising(y, theta) + theta * F.log(theta / (theta + mu)) + y * F.log(mu / (theta + mu))


def _log_inflated(y: Column, pi: Column, mu: Column, theta: Column | None) -> Column:
    return F.when(y == 0, F.log(pi + (1 - pi) * F.exp(_log_zero(mu, theta)))).otherwise(F.log(1 - pi) + _log_count(y, mu, theta))


def _zero_truncated_mean(positive_mean: Column, theta: Column | None) -> Column:
    """mu with mu / (1 - P(0)) = the mean of the positive counts. mu - m (1 - P(0)) is convex and
    positive at m, so Newton's steps from there fall to the root."""
    def step(mu, _):
        p0 = F.exp(_log_zero(mu, theta))
        slope = 1 - positive_mean * p0 * (F.lit(1.0) if theta is None else theta / (theta + mu))
        return F.greatest(mu - (mu - positive_mean * (1 - p0)) / slope, F.lit(1e-12))

    return F.when(positive_mean > 1 + 1e-9, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), positive_mean, step))


def _inflated(n: Column, n0: Column, total: Column, theta: Column | None) -> Column:
    """(pi, mu) of a group: both parts fitted to its share of zeros and its mean of positives; where
    there are fewer zeros than the count part has by itself, pi is 0 (1e-10) and mu the mean."""
    mu = _zero_truncated_mean(total / (n - n0), theta)
    pi = 1 - (n - n0) / n / (1 - F.exp(_log_zero(mu, theta)))
    inside = mu.isNotNull() & (pi > PI_LEAST)
    return F.struct(F.when(inside, F.least(pi, F.lit(1 - PI_LEAST))).otherwise(PI_LEAST).alias("pi"),
                    F.when(inside, mu).otherwise(total / n).alias("mu"))


# ------------------------------------------------------------------ fits on the frequency table

#: Steps of the search for a group's mean.
NEWTON_STEPS = 60
#: The least share of structural zeros.
PI_LEAST = 1e-10
#: log(theta): bounds of the first grid and its step; each pass divides the step by 20.
THETA_BOUNDS, THETA_STEP, THETA_PASSES = (-6.0, 8.0), 0.25, 4


class CountTable:
    """The frequency table (scope, group, y, n), written once, and its groups. ``__s`` names a scope,
    so that NULL scopes meet in joins; every table here has a row per distinct count at most."""

    def __init__(self, df: DataFrame, group: str, y: str, scope: Sequence[str] | str | None = None):
        self.scope = as_list(scope)
        known = df.where(F.col(group).isNotNull())
        name = F.to_json(F.struct(*[F.col(c) for c in self.scope])) if self.scope else F.lit("all")
        self.table = materialize(count_table(known, group, y, self.scope).withColumn("__s", name))
        zero = F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
        self.groups = self.table.groupBy("__s", *self.scope, "group").agg(
            F.sum("n").alias("n"), zero.alias("n0"), F.sum(F.col("n") * F.col("y")).cast("double").alias("total")).where("total > 0")

    def theta(self) -> DataFrame:
        """(__s, tau): log(theta) of the largest profile likelihood, theta shared by the groups of a scope:
        a grid, then finer grids about its best point. For a given theta every group is fitted by
        itself, so the likelihood of a grid point is a sum over groups and distinct counts."""
        lo, hi = THETA_BOUNDS
        none = F.lit(None).cast("long")
        counts = self.table.where("y > 0").groupBy("__s", "y").agg(F.sum("n").alias("n"))
        items = materialize(self.groups.select("__s", "n", "n0", "total", none.alias("y")).unionByName(
            counts.select("__s", "n", none.alias("n0"), F.lit(None).cast("double").alias("total"), "y")))
        step, best = THETA_STEP, None
        reach = round((hi - lo) / 2 / step)
        theta = F.exp("tau")
        fit = _inflated(F.col("n"), F.col("n0"), F.col("total"), theta)
        pi, mu, positive = F.col("p.pi"), F.col("p.mu"), F.col("n") - F.col("n0")
        own = (F.col("n0") * F.log(pi + (1 - pi) * F.exp(_log_zero(mu, theta))) + positive * (F.log(1 - pi) + _log_zero(mu, theta))
               + F.col("total") * F.log(mu / (theta + mu)))
        term = F.when(F.col("y").isNull(), own).otherwise(F.col("n") * _rising(F.col("y"), theta))
        for _ in range(THETA_PASSES):
            about = items.withColumn("tau", F.lit((lo + hi) / 2)) if best is None else items.join(best, "__s")
            points = about.withColumn("i", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("tau", F.col("tau") + F.col("i") * step)
            ll = points.withColumn("p", F.when(F.col("y").isNull(), fit)).groupBy("__s", "tau").agg(F.sum(term).alias("ll"))
            best = materialize(ll.groupBy("__s").agg(F.max_by("tau", "ll").alias("tau")))
            step, reach = step / 20, 24
        return best

    def fits(self, models: set[str]) -> DataFrame:
        """A row per group: n, n0, total, and for each model its ``pi`` and ``mu`` (and ``tau``)."""
        out = self.groups.withColumn("poisson", F.struct(F.lit(0.0).alias("pi"), (F.col("total") / F.col("n")).alias("mu")))
        if "zip" in models:
            out = out.withColumn("zip", _inflated(F.col("n"), F.col("n0"), F.col("total"), None))
        if "zinb" in models:
            out = out.join(self.theta(), "__s").withColumn("zinb", _inflated(F.col("n"), F.col("n0"), F.col("total"), F.exp("tau")))
        return materialize(out)

    def likelihoods(self, fits: DataFrame, models: set[str]) -> DataFrame:
        """Per scope: the log-likelihood of each model, n, the number of groups, and for the Vuong tests
        the sums of the differences from the negative binomial's and of their squares."""
        rows = self.table.select("__s", "group", "y", F.col("n").alias("c")).join(fits, ["__s", "group"])
        y = F.col("y")
        each = {"poisson": _log_count(y, F.col("poisson.mu"), None)}
        if "zip" in models:
            each["zip"] = _log_inflated(y, F.col("zip.pi"), F.col("zip.mu"), None)
        if "zinb" in models:
            each["zinb"] = _log_inflated(y, F.col("zinb.pi"), F.col("zinb.mu"), F.exp("tau"))
        ll = rows.select("__s", *self.scope, "group", "c", *[e.alias(f"ll_{m}") for m, e in each.items()])
        sums = [F.sum("c").alias("big"), F.countDistinct("group").alias("k"), *[F.sum(F.col("c") * F.col(f"ll_{m}")).alias(f"ll_{m}") for m in each]]
        for m in ("poisson", "zip") if models >= {"zip", "zinb"} else ():
            d = F.col("ll_zinb") - F.col(f"ll_{m}")
            sums += [F.sum(F.col("c") * d).alias(f"d_{m}"), F.sum(F.col("c") * d * d).alias(f"q_{m}")]
        return materialize(ll.groupBy("__s", *self.scope).agg(*sums))


def _information(fits: DataFrame, table: CountTable, model: str) -> DataFrame:
    """Per group: ``zeta`` = logit(pi) and ``eta`` = log(mu) with their variances ``vz`` and ``ve`` for a
    known theta, and what links them to log(theta): ``uz``, ``ue`` (the inverse of their block of the
    observed information times their row of log(theta)) and ``rest`` (the group's part of the
    information on log(theta), less what the block takes of it)."""
    if model == "poisson":
        none = F.lit(None).cast("double")
        return fits.select("__s", *table.scope, "group", none.alias("zeta"), F.log("poisson.mu").alias("eta"), none.alias("tau"), none.alias("vz"),
                           (1 / F.col("total")).alias("ve"), none.alias("uz"), F.lit(0.0).alias("ue"), F.lit(0.0).alias("rest"))
    fit = fits.withColumn("pi", F.col(f"{model}.pi")).withColumn("mu", F.col(f"{model}.mu"))
    fit = fit if model == "zinb" else fit.withColumn("tau", F.lit(None).cast("double"))
    n0, pos, total = F.col("n0"), F.col("n") - F.col("n0"), F.col("total")
    pi, mu = F.col("pi"), F.col("mu")
    zero = F.lit(0.0)
    if model == "zinb":
        theta = F.exp("tau")
        k = F.sequence(F.lit(0), F.greatest(F.col("y"), F.lit(1)) - 1)
        part = lambda power: F.aggregate(k, zero, lambda s, i: s + 1 / F.pow(F.exp("tau") + i, F.lit(power)))
        sums = table.table.where("y > 0").join(fit.select("__s", "group", "tau"), ["__s", "group"]).groupBy("__s", "group").agg(
            F.sum(F.col("n") * part(1)).alias("h1"), F.sum(F.col("n") * part(2)).alias("h2"))
        fit = fit.join(sums, ["__s", "group"])
        both = theta + mu
        f = theta * F.log(theta / both)
        fe, fee = -theta * mu / both, -theta * theta * mu / (both * both)
        ft = f + theta * mu / both
        ftt, fet = ft + theta * mu * mu / (both * both), -theta * mu * mu / (both * both)
        bend = theta * mu / (both * both)
        count_ee = pos * fee - total * bend
        count_tt = pos * ftt - total * bend + theta * F.col("h1") - theta * theta * F.col("h2")
        count_et = pos * fet + total * bend
    else:
        f, fe, fee, ft, ftt, fet = -mu, -mu, -mu, zero, zero, zero
        count_ee, count_tt, count_et = -pos * mu, zero, zero
    p0, w = F.exp(f), pi * (1 - pi)
    a = pi + (1 - pi) * p0
    az, ae, at = w * (1 - p0), (1 - pi) * p0 * fe, (1 - pi) * p0 * ft
    second = lambda xy, x, y: n0 * (xy / a - x * y / (a * a))
    izz = -(second(w * (1 - 2 * pi) * (1 - p0), az, az) - pos * w)
    iee = -(second((1 - pi) * p0 * (fe * fe + fee), ae, ae) + count_ee)
    ize = -second(-w * p0 * fe, az, ae)
    izt = -second(-w * p0 * ft, az, at)
    iet = -(second((1 - pi) * p0 * (fe * ft + fet), ae, at) + count_et)
    itt = -(second((1 - pi) * p0 * (ft * ft + ftt), at, at) + count_tt)
    out = fit.select("__s", *table.scope, "group", "pi", "mu", "tau", izz.alias("izz"), iee.alias("iee"), ize.alias("ize"), izt.alias("izt"),
                     iet.alias("iet"), itt.alias("itt"))
    det = F.col("izz") * F.col("iee") - F.col("ize") * F.col("ize")
    uz = F.try_divide(F.col("iee") * F.col("izt") - F.col("ize") * F.col("iet"), det)
    ue = F.try_divide(F.col("izz") * F.col("iet") - F.col("ize") * F.col("izt"), det)
    return out.select("__s", *table.scope, "group", F.log(pi / (1 - pi)).alias("zeta"), F.log(mu).alias("eta"), "tau",
                      F.try_divide(F.col("iee"), det).alias("vz"), F.try_divide(F.col("izz"), det).alias("ve"), uz.alias("uz"), ue.alias("ue"),
                      (F.col("itt") - F.col("izt") * uz - F.col("iet") * ue).alias("rest"))


COUNT_COLUMNS = ("model", "part", "term", "estimate", "std_err", "loglik", "n_params", "aic", "bic", "statistic", "df", "p_value")
_KINDS = {"model": "string", "part": "string", "term": "string", "n_params": "int"}


def _line(**values: Column) -> Column:
    """A row of the report, NULL where not given."""
    return F.struct(*[values.get(c, F.lit(None)).cast(_KINDS.get(c, "double")).alias(c) for c in COUNT_COLUMNS])


def _coefficients(info: DataFrame, likelihoods: DataFrame, scope: list[str], model: str) -> DataFrame:
    """Estimates and standard errors under sum-to-zero contrasts: the mean of the groups' values, and
    each but the last group's distance from it. Groups are linked by theta alone, so the variance of a
    sum c of values is the sum of c^2 v, plus (the sum of c u)^2 times the variance of log(theta)."""
    w = Window.partitionBy("__s")
    g = info.join(likelihoods.select("__s", "big", "k", F.col(f"ll_{model}").alias("ll")), "__s").withColumn("j", F.row_number().over(w.orderBy("group")))
    k, ll = F.col("k").cast("double"), F.col("ll")
    width = {"poisson": k, "zip": 2 * k}.get(model, 2 * k + 1)
    shared = F.sum("rest").over(w) if model == "zinb" else F.lit(float("inf"))
    fit = {"model": F.lit(model), "loglik": ll, "n_params": width}
    scores = {"aic": -2 * ll + 2 * width, "bic": -2 * ll + F.log("big") * width}
    lines = []
    for part, x, v, u in (("zero", "zeta", "vz", "uz"), ("count", "eta", "ve", "ue")):
        if model == "poisson" and part == "zero":
            continue
        mean, common, us = F.avg(x).over(w), F.sum(v).over(w) / (k * k), F.avg(u).over(w)
        var = common + us * us / shared
        lines.append(F.when(F.col("j") == 1, _line(**fit, **scores, part=F.lit(part), term=F.lit("(Intercept)"), estimate=mean,
                                                   std_err=F.when(var >= 0, F.sqrt(var)))))
        lift = F.col(u) - us
        var = F.col(v) * (1 - 2 / k) + common + lift * lift / shared
        lines.append(F.when(F.col("j") < F.col("k"), _line(**fit, **scores, part=F.lit(part), term=F.concat(F.lit("group"), F.col("j").cast("string")),
                                                           estimate=F.col(x) - mean, std_err=F.when(var >= 0, F.sqrt(var)))))
    if model == "zinb":
        lines.append(F.when(F.col("j") == 1, _line(**fit, part=F.lit("dispersion"), term=F.lit("log(theta)"), estimate=F.col("tau"),
                                                   std_err=F.when(shared > 0, 1 / F.sqrt(shared)))))
    rows = g.select(*scope, F.array(*lines).alias("lines"))
    return rows.select(*scope, F.inline(F.filter("lines", lambda x: x.isNotNull())))


def _vuong(likelihoods: DataFrame, scope: list[str]) -> DataFrame:
    """Vuong tests of the negative binomial against each other model, raw and corrected."""
    n, lines = F.col("big").cast("double"), []
    for other, more in (("poisson", F.col("k") + 1), ("zip", F.lit(1))):  # parameters more than the other's
        total = F.col(f"d_{other}")
        sd = F.sqrt(F.try_divide(F.col(f"q_{other}") - total * total / n, n - 1))
        for label, corr in (("raw", F.lit(0.0)), ("aic", more.cast("double")), ("bic", more * F.log(n) / 2)):
            lines.append(_line(model=F.lit("vuong"), part=F.lit(f"zinb_vs_{other}"), term=F.lit(label), statistic=F.try_divide(total - corr, F.sqrt(n) * sd)))
    out = likelihoods.select(*scope, F.inline(F.array(*lines)))
    z = F.col("statistic")
    return out.withColumn("p_value", dist.chi2_sf_col(z * z, 1.0) / 2)


def _wald(info: DataFrame, scope: list[str]) -> DataFrame:
    """Wald tests of the factor in both parts: x' P x - (1' P x)^2 / (1' P 1), P the inverse of the
    groups' covariance, which is diagonal but for theta's part (Sherman and Morrison)."""
    sums, lines = [], []
    for part, x, v, u in (("zero", "zeta", "vz", "uz"), ("count", "eta", "ve", "ue")):
        x, d, u = F.col(x), 1 / F.col(v), F.col(u)
        terms = {"xx": x * x * d, "x1": x * d, "one": d, "ux": u * x * d, "u1": u * d, "uu": u * u * d}
        sums += [F.sum(e).alias(f"{part}_{k}") for k, e in terms.items()]
        xx, x1, one, ux, u1, uu = (F.col(f"{part}_{k}") for k in terms)
        den = uu + F.col("rest")
        px, pp = x1 - u1 * ux / den, one - u1 * u1 / den
        lines.append(_line(model=F.lit("wald"), part=F.lit(part), term=F.lit("group"), statistic=xx - ux * ux / den - F.try_divide(px * px, pp), df=F.col("df")))
    out = info.groupBy("__s", *scope).agg(*sums, F.sum("rest").alias("rest"), (F.count(F.lit(1)) - 1).alias("df")).select(*scope, F.inline(F.array(*lines)))
    return out.withColumn("p_value", dist.chi2_sf_col("statistic", F.col("df").cast("double")))


def fit_count_models(df: DataFrame, group: str, y: str, scope: Sequence[str] | str | None = None,
                     models: Sequence[str] = ("poisson", "zip", "zinb", "vuong", "wald")) -> DataFrame:
    """Poisson, ZIP and ZINB fits, Vuong tests and Wald tests per scope (M11-M15); ``models`` names
    those that are wanted, and only what they need is fitted.

    Output columns: scope..., model, part, term, estimate, std_err, loglik,
    n_params, aic, bic, statistic, df, p_value. Terms use sum-to-zero
    contrasts over the sorted group labels: group1 .. group{k-1}. Rows without a group or a count are
    left out, as are groups without a positive count, which have no finite estimate.
    """
    table = CountTable(df, group, y, scope)
    need = {m for m in models if m in ("poisson", "zip", "zinb")}
    need |= {"poisson", "zip", "zinb"} if "vuong" in models else {"zinb"} if "wald" in models else set()
    fits = table.fits(need)
    ll = table.likelihoods(fits, need)
    info = {m: _information(fits, table, m) for m in need if m in models or m == "zinb"}
    if "zinb" in info and {"zinb", "wald"} <= set(models):
        info["zinb"] = materialize(info["zinb"])
    parts = [_coefficients(info[m], ll, table.scope, m) for m in ("poisson", "zip", "zinb") if m in models]
    parts += [_vuong(ll, table.scope)] if "vuong" in models else []
    parts += [_wald(info["zinb"], table.scope)] if "wald" in models else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def poisson_contrasts(df: DataFrame, group: str, y: str, scope: Sequence[str] | str | None = None) -> DataFrame:
    """Poisson GLM coefficients under sum-to-zero contrasts, pure Spark.

    With one factor the fitted log-means are the log group means eta_g with
    variance 1/sum(y_g). Intercept = mean of eta_g; effect j = eta_j - intercept
    for the first k-1 groups in label order. Windows run over the k groups of a
    scope only.
    """
    scope = as_list(scope)
    g = poisson_means(df, group, y, scope).withColumn("__inv", F.try_divide(F.lit(1.0), F.col("total")))
    w = Window.partitionBy(*scope)
    # a group with no events has eta = -inf: the scope's coefficients are then undefined (NULL)
    complete = F.count("eta").over(w) == F.count(F.lit(1)).over(w)
    g = (g.withColumn("__k", F.count(F.lit(1)).over(w))
         .withColumn("__b0", F.when(complete, F.avg("eta").over(w)))
         .withColumn("__sinv", F.when(complete, F.sum("__inv").over(w)))
         .withColumn("__j", F.row_number().over(w.orderBy("group"))))
    k = F.col("__k").cast("double")
    icpt = (g.where(F.col("__j") == 1)
            .select(*scope, F.lit("(Intercept)").alias("term"), F.col("__b0").alias("estimate"),
                    F.sqrt(F.col("__sinv") / (k * k)).alias("std_err")))
    eff = (g.where(F.col("__j") < F.col("__k"))
           .select(*scope, F.concat(F.lit("group"), F.col("__j").cast("string")).alias("term"),
                   (F.col("eta") - F.col("__b0")).alias("estimate"),
                   F.sqrt((1 - 2 / k) * F.col("__inv") + F.col("__sinv") / (k * k)).alias("std_err")))
    return icpt.unionByName(eff)
