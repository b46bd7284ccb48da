"""Models (M1-M10): ordinary least squares from one aggregate pass, and Spark
ML pipelines for the linear, lasso, logistic, forest and boosted models.

OLS needs only means and covariances — (p + 1)^2 / 2 of them, one distributed aggregate —
and a second pass for residual moments; the p x p solve runs on the driver
and is bounded by the number of predictors, never by rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dist
from tessera.operators.forest import GrownForestRegressor


@dataclass
class OlsFit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    df_resid: int
    sse: float
    sst: float
    moments: dict
    rank: int = 0

    def coefficients(self, spark: SparkSession | None = None, level: float = 0.95) -> DataFrame:
        """term, coef, std_err, t, p_value, ci_low, ci_high (statsmodels' summary table)."""
        spark = spark or SparkSession.getActiveSession()
        q = dist.t_ppf(1 - (1 - level) / 2, self.df_resid)
        rows = []
        for i, t in enumerate(self.terms):
            se = float(math.sqrt(self.cov[i, i])) if self.cov[i, i] >= 0 else float("nan")
            tv = float(self.coef[i] / se) if se > 0 else float("nan")
            rows.append((t, float(self.coef[i]), se, tv, dist.t_two_sided(tv, self.df_resid),
                         float(self.coef[i] - q * se), float(self.coef[i] + q * se)))
        return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, "
                                           "p_value double, ci_low double, ci_high double")

    def stats(self) -> dict:
        n, k = self.n, len(self.terms)
        r2 = 1 - self.sse / self.sst if self.sst > 0 else float("nan")
        p = k - 1
        adj = 1 - (1 - r2) * (n - 1) / self.df_resid if self.df_resid > 0 else float("nan")
        f = ((self.sst - self.sse) / p) / (self.sse / self.df_resid) if p > 0 and self.sse > 0 else float("nan")
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(self.sse / n) + 1) if self.sse > 0 else float("nan")
        m = self.moments
        skew = m["skew"] if m["m2"] > 0 else float("nan")
        kurt = m["excess"] + 3 if m["m2"] > 0 else float("nan")
        jb = n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4)
        return {"n": float(n), "r2": r2, "adj_r2": adj, "f": f, "f_p_value": dist.f_sf(f, p, self.df_resid),
                "log_likelihood": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + math.log(n) * k,
                "rmse": math.sqrt(self.sse / n), "skew": skew, "kurtosis": kurt, "jarque_bera": jb,
                "jb_p_value": dist.chi2_sf(jb, 2)}

    def stats_frame(self, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([(k, float(v)) for k, v in self.stats().items()], "metric string, value double")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        expr = F.lit(float(self.coef[0]))
        for t, b in zip(self.terms[1:], self.coef[1:]):
            expr = expr + F.col(t) * F.lit(float(b))
        return df.withColumn(out, expr)


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> OlsFit:
    """Least squares with intercept (M1, M2 without penalty). Rows with a NULL
    in y or any x are dropped, as the formula interface does. Moments are centred;
    collinear or constant predictors get the smallest coefficients and ``rank`` tells of them."""
    xs = list(xs)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in xs], F.col(y).cast("double").alias("__y")).na.drop()
    cols = [*xs, "__y"]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    r = d.agg(*aggs).first()
    n, k = r["n"], len(cols)
    if not n:
        raise ValueError("no row has a value in every column")
    mean = np.array([r[f"m_{i}"] for i in range(k)])
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = r[f"c_{i}_{j}"] * n
    # solved in correlation units, so neither offsets nor scales of the predictors matter
    unit = np.sqrt(np.diag(s)[:-1])
    unit[unit == 0] = 1.0
    scaled = s[:-1, :-1] / np.outer(unit, unit)
    slopes = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) / np.outer(unit, unit)
    rank = 1 + (int(np.linalg.matrix_rank(scaled, tol=1e-12 * max(1, k - 1), hermitian=True)) if xs else 0)
    b = slopes @ s[:-1, -1]
    beta = np.concatenate([[mean[-1] - mean[:-1] @ b], b])
    inv = np.zeros((k, k))
    inv[1:, 1:] = slopes
    inv[0, 1:] = inv[1:, 0] = -slopes @ mean[:-1]
    inv[0, 0] = 1 / n + mean[:-1] @ slopes @ mean[:-1]
    fit = OlsFit(["Intercept", *xs], beta, inv, n, n - rank, 0.0, float(s[-1, -1]), {}, rank)
    pred = fit.predict(d.select(*xs, "__y"), "__p")
    res = F.col("__y") - F.col("__p")
    m = pred.agg(F.sum(res * res).alias("sse"), F.var_pop(res).alias("m2"), F.skewness(res).alias("skew"),
                 F.kurtosis(res).alias("excess")).first()  # centred moments
    fit.sse = float(m["sse"])
    fit.moments = {k: m[k] for k in ("m2", "skew", "excess")}
    sigma2 = fit.sse / fit.df_resid if fit.df_resid > 0 else float("nan")
    fit.cov = inv * sigma2
    return fit


def durbin_watson(df: DataFrame, residual: str, order: Sequence[str] | str) -> DataFrame:
    """(n, durbin_watson): the sum of squared steps between successive residuals over their sum of
    squares (M1). Rows without a residual are left out; ``order`` must tell all rows apart.

    Rows are range-partitioned and sorted within partitions; each task adds up its own steps and
    passes on its first and last residual, and the steps across the borders are taken between
    neighbouring partitions (one row each).
    """
    order = [order] if isinstance(order, str) else list(order)
    rows = df.where(F.col(residual).isNotNull()).select(*order, F.col(residual).cast("double").alias("__e"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__e")

    def run(parts):
        n, first, last, steps, squares = 0, None, None, 0.0, 0.0
        for b in parts:
            e = b.column(0).to_numpy()
            if not len(e):
                continue
            first = e[0] if first is None else first
            steps += float((np.diff(e, prepend=e[0] if last is None else last) ** 2).sum())
            squares += float((e * e).sum())
            n, last = n + len(e), e[-1]
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"task": [task], "n": [n], "first": [first], "last": [last], "steps": [steps], "squares": [squares]})

    each = rows.mapInArrow(run, "task long, n long, first double, last double, steps double, squares double")
    border = F.col("first") - F.lag("last").over(Window.orderBy("task"))  # a row for each partition
    each = each.withColumn("border", F.coalesce(border * border, F.lit(0.0)))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                    F.try_divide(F.sum(F.col("steps") + F.col("border")), F.sum("squares")).alias("durbin_watson"))


# ------------------------------------------------------------------ Spark ML

def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def fit_pipeline(df: DataFrame, stages: list) -> PipelineModel:
    return Pipeline(stages=stages).fit(df)


#: Bins and bootstrap counts (4 bytes each) that fits running together may hold on all executors.
TOGETHER_VALUES = 1_500_000_000


def together(rows: int, values: int, most: int) -> int:
    """How many of ``most`` fits run at once, each on ``rows`` rows of ``values`` bins and counts: as
    many as hold ``TOGETHER_VALUES``, so that they stay in memory; at least one."""
    return max(1, min(most, TOGETHER_VALUES // max(1, rows * values)))


def linear(features: Sequence[str], label: str, alpha: float = 0.0, l1: bool = False) -> list:
    """Linear regression (M2) or lasso (M3, ``l1=True``): Spark's objective is
    1/(2n) ||y - Xb||^2 + alpha ||b||_1, scikit-learn's Lasso objective."""
    est = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha,
                           elasticNetParam=1.0 if l1 else 0.0, standardization=False,
                           solver="auto" if l1 else "normal", maxIter=1000, tol=1e-9)
    return [assembler(features), est]


def forest_regressor(features: Sequence[str], label: str, num_trees: int = 10, max_depth: int | None = None,
                     seed: int = 42) -> list:
    """Random-forest regressor with all features per split (M4), whose trees are grown to the end where
    ``max_depth`` is None, as the source's are. Its model tells importances."""
    return [GrownForestRegressor(features, label, num_trees, max_depth, seed)]


def forest_classifier(features: Sequence[str], label: str, num_trees: int = 100, max_features: int | None = 20,
                      max_depth: int = 10, seed: int = 42) -> list:
    """Random-forest classifier, ``max_features`` candidate features per split (M5), counted in
    the assembled vector, which is wider than ``features`` where inputs are one-hot vectors. Node ids
    are not cached: they take up as many numbers a row as there are trees, three times over and once more
    in the shared folder, where a walk down a tree of bounded depth costs little."""
    strategy = str(max_features) if max_features else "auto"
    est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                 featureSubsetStrategy=strategy, maxDepth=max_depth, seed=seed)
    return [assembler(features), est]


def logistic(features: Sequence[str], label: str, n_rows: int, c: float = 1.0, max_iter: int = 2000) -> list:
    """L2 logistic regression equivalent to scikit-learn's C (M6): scikit-learn
    minimises C * sum(loss) + ||w||^2 / 2, Spark mean(loss) + reg/2 ||w||^2,
    so reg = 1 / (C * n)."""
    est = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(n_rows, 1)),
                             elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    return [assembler(features), est]


def gbt(features: Sequence[str], label: str, num_trees: int = 100, max_depth: int = 3, step: float = 0.1,
        seed: int = 42) -> list:
    """Gradient-boosted trees classifier (M7). Its trees are shallow: walking one again costs less than
    caching and zipping the node ids of every row at each level."""
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=num_trees, maxDepth=max_depth,
                        stepSize=step, seed=seed)
    return [assembler(features), est]


def with_score(pred: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1 (M8)."""
    from pyspark.ml.functions import vector_to_array
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


def feature_weights(model: PipelineModel, features: Sequence[str], kind: str = "importance",
                    absolute: bool = False) -> DataFrame:
    """Feature importances or coefficients as (feature, weight), sorted (M9)."""
    last = model.stages[-1]
    if kind == "importance":
        w = last.featureImportances.toArray()
    else:
        w = np.asarray(last.coefficients.toArray() if hasattr(last, "coefficients") else last.coefficientMatrix.toArray()[0])
    if absolute:
        w = np.abs(w)
    spark = SparkSession.getActiveSession()
    rows = [(f, float(x)) for f, x in zip(features, w)]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.desc("weight"), "feature")


def top_features(weights: DataFrame, k: int) -> list[str]:
    """Names of the ``k`` heaviest features (M10; the list is bounded by k)."""
    return [r["feature"] for r in weights.orderBy(F.desc("weight"), "feature").limit(k).collect()]
