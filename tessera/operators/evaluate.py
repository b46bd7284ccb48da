"""Model evaluation (E1-E10): ROC points, AUC, threshold sweeps, regression metrics.

Scores are grouped by value first (a score shared by a third of all rows is
one row), cumulative positives/negatives come from the bucketed cumulative
counts, and the AUC uses the rank form with mid-ranks, which equals the
trapezoidal area under the ROC curve including ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators._util import as_list, attach_scalars
from tessera.operators.rank import cumulative_counts


def _judged(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that have both a score and a label."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull())


def _score_table(df: DataFrame, label: str, score: str, scope: list[str]) -> DataFrame:
    y = F.col(label).cast("double")
    return (_judged(df, label, score)
            .groupBy(*scope, F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.count(F.lit(1)).alias("n")))


def roc_points(df: DataFrame, label: str, score: str, scope: Sequence[str] | str | None = None) -> DataFrame:
    """ROC curve: one point per distinct score, predicting positive when
    score >= threshold (E4), with false-negative rate (E7)."""
    scope = as_list(scope)
    st = _score_table(df, label, score, scope).withColumn("neg_score", -F.col("score"))
    above = cumulative_counts(st, scope, "neg_score", ["pos", "neg"], out=["__pos_above", "__neg_above"],
                              bounds=(_judged(df, label, score), -F.col(score).cast("double")))
    tot = (st.groupBy(*scope) if scope else st).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    if scope:
        j = above.join(tot, scope)
    else:
        # class totals from a narrow scan of the input, not from the shuffled score table
        y = F.col(label).cast("double")
        raw = _judged(df, label, score).agg(F.sum(y).alias("__P"), F.sum(1 - y).alias("__N"))
        j = attach_scalars(above, raw)
    tp = F.col("__pos_above") + F.col("pos")
    fp = F.col("__neg_above") + F.col("neg")
    return j.select(*scope, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.try_divide(fp, F.col("__N")).alias("fpr"), F.try_divide(tp, F.col("__P")).alias("tpr"),
                    (1 - F.try_divide(tp, F.col("__P"))).alias("fnr"))


def auc(df: DataFrame, label: str, score: str, scope: Sequence[str] | str | None = None) -> DataFrame:
    """Area under the ROC curve by the rank form (E5, E6 with ``scope=fold``):
    (R_pos - n_pos (n_pos + 1) / 2) / (n_pos n_neg). NULL for one class."""
    scope = as_list(scope)
    y = F.col(label).cast("int")
    # one row per score, so the rows of both classes are ranked without joining them to their ranks
    ties = (_judged(df, label, score)
            .groupBy(*scope, F.col(score).cast("double").alias("__v"))
            .agg(F.count_if(y == 1).alias("__p"), F.count_if(y != 1).alias("__q"), F.count(F.lit(1)).alias("__t")))
    ranked = cumulative_counts(ties, scope, "__v", "__t", out="__below", bounds=(_judged(df, label, score), score))
    midrank = F.col("__below") + (F.col("__t") + 1) / 2.0
    agg = [F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"), F.sum(F.col("__p") * midrank).alias("__r")]
    s = ranked.groupBy(*scope).agg(*agg) if scope else ranked.agg(*agg)
    npos = F.col("n_pos").cast("double")
    val = F.try_divide(F.col("__r") - npos * (npos + 1) / 2, npos * F.col("n_neg"))
    return s.select(*scope, F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
                    F.coalesce("n_neg", F.lit(0)).alias("n_neg"), val.alias("auc"))


def threshold_sweep(df: DataFrame, label: str, score: str,
                    thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Confusion matrix, accuracy, false-positive and false-negative rate at each
    threshold, predicting positive when score > t (E7-E9), over the rows that have a score and a
    label. One scan: four conditional counts per threshold, then unpivoted."""
    y = F.col(label).cast("int") == 1
    s = F.col(score)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        p = s > F.lit(t)
        aggs += [F.count_if(p & y).alias(f"tp{i}"), F.count_if(p & ~y).alias(f"fp{i}"),
                 F.count_if(~p & ~y).alias(f"tn{i}"), F.count_if(~p & y).alias(f"fn{i}")]
    wide = _judged(df, label, score).agg(*aggs)
    structs = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                        F.col(f"tn{i}").alias("tn"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)]
    out = wide.select("n", F.inline(F.array(*structs)))
    return out.select("threshold", "tp", "fp", "tn", "fn",
                      F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                      F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                      F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


def regression_metrics(df: DataFrame, label: str, prediction: str,
                       scope: Sequence[str] | str | None = None) -> DataFrame:
    """R^2 = 1 - SSE/SST and RMSE (E1), one aggregate pass over the rows that have a label and a
    prediction; ``n`` counts these."""
    scope = as_list(scope)
    df = _judged(df, label, prediction)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    agg = [F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("__sse"), F.var_pop(y).alias("__vy")]
    s = df.groupBy(*scope).agg(*agg) if scope else df.agg(*agg)
    return s.select(*scope, "n", (1 - F.try_divide(F.col("__sse"), F.col("__vy") * F.col("n"))).alias("r2"),
                    F.sqrt(F.try_divide(F.col("__sse"), F.col("n"))).alias("rmse"))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Residual = actual - fitted, next to both."""
    return df.withColumn("residual", F.col(label) - F.col(prediction))


def approval_cutoff(df: DataFrame, score: str, approve_share: float = 0.2) -> DataFrame:
    """Score cut-off that keeps the best ``approve_share`` of applicants (E10):
    the exact (1 - share) quantile of the default probability's complement."""
    from tessera.operators.rank import exact_quantiles
    return exact_quantiles(df, score, [1 - approve_share]).select(F.col("q").alias("cutoff"))
