"""OLS, ML wrappers and count models on planted data."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from tessera.operators import counts, models


def test_ols_matches_numpy(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(300):
        x1, x2 = rnd.uniform(0, 10), float(rnd.random() < 0.5)
        rows.append((x1, x2, 3.0 + 0.8 * x1 - 2.0 * x2 + rnd.gauss(0, 1)))
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    fit = models.ols(df, "y", ["x1", "x2"])
    X = np.array([[1, a, b] for a, b, _ in rows])
    y = np.array([c for _, _, c in rows])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert fit.coef == pytest.approx(beta, rel=1e-8)
    resid = y - X @ beta
    s2 = resid @ resid / (300 - 3)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    coefs = {r["term"]: r for r in fit.coefficients(spark).collect()}
    assert coefs["x1"]["std_err"] == pytest.approx(se[1], rel=1e-6)
    assert coefs["x1"]["ci_low"] < 0.8 < coefs["x1"]["ci_high"]
    st = fit.stats()
    assert st["r2"] == pytest.approx(1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())), rel=1e-9)


def test_lasso_shrinks_noise_feature(spark):
    rnd = random.Random(2)
    rows = [(a, b, 2 * a + 0.01 * rnd.gauss(0, 1)) for a, b in ((rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(400))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = models.fit_pipeline(df, models.linear(["a", "b"], "y", 0.05, l1=True))
    c = m.stages[-1].coefficients.toArray()
    assert c[0] == pytest.approx(2 - 0.05, abs=0.02)
    assert abs(c[1]) < 0.01


def test_logistic_forest_gbt_score(spark):
    rnd = random.Random(3)
    rows = [(x, int(x + rnd.gauss(0, 0.5) > 0)) for x in (rnd.gauss(0, 1) for _ in range(300))]
    df = spark.createDataFrame(rows, "x double, y int")
    for stages in (models.logistic(["x"], "y", 300), models.forest_classifier(["x"], "y", 5, max_depth=3),
                   models.gbt(["x"], "y", 5, 2)):
        m = models.fit_pipeline(df, stages)
        s = models.with_score(m.transform(df))
        from tessera.operators import evaluate
        assert evaluate.auc(s, "y", "score").first()["auc"] > 0.8


def _zip_rows(rnd, groups):
    rows = []
    for g, (pi, lam, n) in groups.items():
        for _ in range(n):
            if rnd.random() < pi:
                y = 0
            else:
                # Poisson draw by inversion
                L, k, p = math.exp(-lam), 0, 1.0
                while True:
                    p *= rnd.random()
                    if p <= L:
                        break
                    k += 1
                y = k
            rows.append((g, y))
    return rows


def test_zip_recovers_planted_parameters(spark):
    rnd = random.Random(9)
    planted = {"a": (0.6, 1.2, 4000), "b": (0.5, 2.0, 4000), "c": (0.3, 3.0, 4000)}
    df = spark.createDataFrame(_zip_rows(rnd, planted), "g string, y int")
    out = counts.fit_count_models(df, "g", "y").toPandas()
    z = out[(out.model == "zip") & (out.part == "count")].set_index("term")["estimate"]
    # recover per-group log lambda from sum-to-zero coefficients
    eta = [z["(Intercept)"] + z["group1"], z["(Intercept)"] + z["group2"],
           z["(Intercept)"] - z["group1"] - z["group2"]]
    for e, (_, lam, _) in zip(eta, planted.values()):
        assert math.exp(e) == pytest.approx(lam, rel=0.08)
    # Poisson fit: mean per group is the sample mean
    p = out[(out.model == "poisson")].set_index("term")["estimate"]
    assert np.isfinite(p.values).all()
    v = out[out.model == "vuong"]
    assert len(v) == 6
    w = out[out.model == "wald"]
    assert set(w.part) == {"zero", "count"}


def test_zip_closed_form_equation(spark):
    df = spark.createDataFrame([(1000.0, 600.0, 700.0), (100.0, 1.0, 300.0), (100.0, 60.0, 40.0)], "n double, n0 double, total double")
    a, few_zeros, ones = df.select(counts._inflated(F.col("n"), F.col("n0"), F.col("total"), None).alias("p")).collect()
    pi, lam = a["p"]["pi"], a["p"]["mu"]
    # lambda / (1 - exp(-lambda)) equals the mean of positives
    assert lam / (1 - math.exp(-lam)) == pytest.approx(700 / 400, rel=1e-9)
    assert (1 - pi) * (1 - math.exp(-lam)) == pytest.approx(400 / 1000, rel=1e-9)
    # fewer zeros than a Poisson count has, and no positive count above one: a plain Poisson
    assert few_zeros["p"]["pi"] == pytest.approx(1e-10) and few_zeros["p"]["mu"] == 3.0
    assert ones["p"]["pi"] == pytest.approx(1e-10) and ones["p"]["mu"] == 0.4


def test_count_models_against_numerical_maximum(spark):
    """ZINB fits, their information and the tests against likelihoods written out and differentiated
    numerically."""
    rnd = random.Random(4)
    rows = [(g, int(y * (1 + 2 * rnd.random())), s) for s in ("x", None) for g, y in _zip_rows(rnd, {"a": (0.6, 1.2, 500), "b": (0.4, 2.0, 500)})]
    df = spark.createDataFrame([*rows, (None, 3, "x"), ("a", None, "x"), ("empty", 0, "x")], "g string, y int, s string")
    out = counts.fit_count_models(df, "g", "y", "s").toPandas()
    for s in ("x", None):
        mine = out[out["s"].isna() if s is None else out["s"] == s]
        data = [(g, y) for g, y, ss in rows if ss == s]
        z = {(r.part, r.term): r for r in mine[mine.model == "zinb"].itertuples()}
        first = np.array([z["zero", "(Intercept)"].estimate, z["zero", "group1"].estimate, z["count", "(Intercept)"].estimate,
                          z["count", "group1"].estimate, z["dispersion", "log(theta)"].estimate])

        def ll(x):
            total = 0.0
            for j, g in enumerate("ab"):
                sign, th = 1 - 2 * j, math.exp(x[4])
                pi, mu = 1 / (1 + math.exp(-(x[0] + sign * x[1]))), math.exp(x[2] + sign * x[3])
                for y, n in zip(*np.unique([y for gg, y in data if gg == g], return_counts=True)):
                    lp = (math.lgamma(y + th) - math.lgamma(th) - math.lgamma(y + 1) + th * math.log(th / (th + mu)) + y * math.log(mu / (th + mu)))
                    total += n * (math.log(pi + (1 - pi) * math.exp(lp)) if y == 0 else math.log(1 - pi) + lp)
            return total

        best = ll(first)
        assert best == pytest.approx(z["count", "group1"].loglik, rel=1e-10)
        step = np.eye(5) * 1e-3
        assert all(ll(first + d) <= best + 1e-6 and ll(first - d) <= best + 1e-6 for d in step)
        hess = np.array([[(ll(first + a + b) - ll(first + a - b) - ll(first - a + b) + ll(first - a - b)) / 4e-6 for b in step] for a in step])
        cov = np.linalg.inv(-hess)
        errors = [z[k].std_err for k in (("zero", "(Intercept)"), ("zero", "group1"), ("count", "(Intercept)"), ("count", "group1"), ("dispersion", "log(theta)"))]
        assert errors == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-3)
        w = mine[mine.model == "wald"].set_index("part")["statistic"]
        assert w["zero"] == pytest.approx(first[1] ** 2 / cov[1, 1], rel=1e-3) and w["count"] == pytest.approx(first[3] ** 2 / cov[3, 3], rel=1e-3)
    assert len(out[out.model == "vuong"]) == 12 and out[out.model == "poisson"].estimate.notna().all()
    some = counts.fit_count_models(df, "g", "y", "s", ("wald",)).toPandas()
    assert set(some.model) == {"wald"}


def test_poisson_contrasts_match_count_models(spark):
    rnd = random.Random(5)
    rows = [(g, int(rnd.random() * k)) for g, k in (("a", 3), ("b", 5), ("c", 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int")
    a = {r["term"]: (r["estimate"], r["std_err"]) for r in counts.poisson_contrasts(df, "g", "y").collect()}
    full = counts.fit_count_models(df, "g", "y").toPandas()
    b = full[full.model == "poisson"].set_index("term")
    for t, (est, se) in a.items():
        assert est == pytest.approx(b.loc[t, "estimate"], rel=1e-9)
        assert se == pytest.approx(b.loc[t, "std_err"], rel=1e-9)


def test_ols_standard_errors_match_spark_normal_solver(spark):
    rnd = random.Random(12)
    rows = [(x, 1.5 + 0.7 * x + rnd.gauss(0, 2)) for x in (rnd.uniform(0, 20) for _ in range(500))]
    df = spark.createDataFrame(rows, "x double, y double")
    fit = models.ols(df, "y", ["x"])
    m = models.fit_pipeline(df, models.linear(["x"], "y")).stages[-1]
    se = {r["term"]: r["std_err"] for r in fit.coefficients(spark).collect()}
    # Spark lists the slope first and the intercept last
    assert se["x"] == pytest.approx(m.summary.coefficientStandardErrors[0], rel=1e-6)
    assert se["Intercept"] == pytest.approx(m.summary.coefficientStandardErrors[1], rel=1e-6)


def test_poisson_means_equal_spark_glm_fit(spark):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    rnd = random.Random(13)
    rows = [(g, int(rnd.random() * k)) for g, k in (("a", 4), ("b", 7), ("c", 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, y int")
    idx = StringIndexer(inputCol="g", outputCol="gi").fit(df).transform(df)
    enc = OneHotEncoder(inputCol="gi", outputCol="gv").fit(idx).transform(idx)
    data = VectorAssembler(inputCols=["gv"], outputCol="features").transform(enc).withColumn("y", F.col("y").cast("double"))
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y").fit(data)
    pred = {r["g"]: r["prediction"] for r in glm.transform(data).select("g", "prediction").distinct().collect()}
    means = {r["group"]: r["mean"] for r in counts.poisson_means(df, "g", "y").collect()}
    for g in means:
        assert pred[g] == pytest.approx(means[g], rel=1e-6)
