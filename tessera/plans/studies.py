"""End-to-end studies (C1-C6) composed from the operators.

Each study returns result DataFrames instead of printing a report; models are
Spark ML pipelines; every statistic is a distributed aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import evaluate, htest, joins, models, prep, sampling, smote, summary
from tessera.operators._util import attach_scalars, spread
from tessera.session import materialize
from tessera.sources import standins as S

# ------------------------------------------------------------------ C1 feature ranking


def feature_ranking(df: DataFrame, y: str, features: Sequence[str], min_sd: float = 0.2,
                    collinear_at: float = 0.8, lasso_alpha: float = 0.001, forest_trees: int = 10,
                    forest_depth: int | None = None, seed: int = 42) -> DataFrame:
    """Clean -> variance filter -> collinearity -> rankings -> mean score.

    Returns (feature, method, score) with methods Corr, Linear Regression (only
    without collinearity), Lasso, Random Forest and avg_scores; scores are
    min-max scaled to [0, 1] and rounded to 3 digits like the reference report. The forest's trees
    are grown to the end unless ``forest_depth`` limits them.
    """
    features = list(features)
    _, clean = prep.missing_policy(df.select(y, *features), features)
    var = prep.variance_report(clean, features, min_sd).where("kept").select("column").collect()
    kept = [r["column"] for r in var]  # one row per feature
    pairs = prep.corr_pairs(clean, kept)
    collinear = bool(prep.collinear_flag(pairs, collinear_at).first()["collinear"])
    z = spread(materialize(prep.standardise(clean.select(y, *kept), [y, *kept])))
    scores = [htest.f_scores(z, y, kept, with_p=False).select("feature", F.col("f").alias("raw"))
              .withColumn("method", F.lit("Corr"))]
    # the model fits are independent jobs: submit them together
    from concurrent.futures import ThreadPoolExecutor
    specs = {"Lasso": (models.linear(kept, y, lasso_alpha, l1=True), "coef", False),
             "Random Forest": (models.forest_regressor(kept, y, forest_trees, forest_depth, seed=seed), "importance", False)}
    if not collinear:
        specs["Linear Regression"] = (models.linear(kept, y), "coef", True)
    with ThreadPoolExecutor(max_workers=len(specs)) as pool:
        fitted = dict(zip(specs, pool.map(lambda k: models.fit_pipeline(z, specs[k][0]), specs)))
    for method, (_, kind, absolute) in specs.items():
        scores.append(models.feature_weights(fitted[method], kept, kind, absolute=absolute)
                      .select("feature", F.col("weight").alias("raw")).withColumn("method", F.lit(method)))
    long = joins.union_all(scores)
    w = Window.partitionBy("method")  # one partition per ranking method, |features| rows each
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    scaled = long.withColumn("score", F.round(F.when(hi == lo, F.lit(0.0))
                                              .otherwise((F.col("raw") - lo) / (hi - lo)), 3)).drop("raw")
    avg = (scaled.groupBy("feature").agg(F.round(F.avg("score"), 3).alias("score"))
           .withColumn("method", F.lit("avg_scores")))
    return materialize(scaled.unionByName(avg).select("feature", "method", "score"))


def selected_features(ranking: DataFrame) -> DataFrame:
    """Features whose average score is above zero."""
    return ranking.where((F.col("method") == "avg_scores") & (F.col("score") > 0)).select("feature")


def feature_lists(df: DataFrame, y: str, features: Sequence[str], p_below: float = 0.01, min_sd: float = 0.2, **ranking) -> DataFrame:
    """(list, feature, value): the lists that the feature-ranking report ends with (C1). ``significant``
    are the kept features whose univariate F-test has a p-value under ``p_below``, with it;
    ``selected`` are those with an average score above zero, with it."""
    features = list(features)
    _, clean = prep.missing_policy(df.select(y, *features), features)
    kept = [r["column"] for r in prep.variance_report(clean, features, min_sd).where("kept").select("column").collect()]
    tests = htest.f_scores(clean, y, kept).where(F.col("p_value") < p_below)
    ranked = feature_ranking(df, y, features, min_sd, **ranking)
    chosen = selected_features(ranked).join(ranked.where(F.col("method") == "avg_scores"), "feature")
    return tests.select(F.lit("significant").alias("list"), "feature", F.col("p_value").alias("value")).unionByName(
        chosen.select(F.lit("selected").alias("list"), "feature", F.col("score").alias("value")))


# ------------------------------------------------------------------ C2 repay decision

_CAT = ["age_bucket", "is_returning_customer", "genre", "difficulty", "fiction"]


def purchase_model_frame(spark: SparkSession, sf: str, month: str) -> DataFrame:
    return joins.enrich_assortment(S.customer_features(spark, sf), S.product_features(spark, sf),
                                   S.assortment(spark, sf, month))


def purchase_encoders(levels: DataFrame) -> list:
    """Fitted encoders of the purchase model. They are learned from the distinct categories alone:
    levels are numbered in order of the alphabet, however often they occur."""
    from pyspark.ml import Pipeline
    enc, vecs = prep.ml_one_hot(_CAT)
    return [*Pipeline(stages=enc).fit(levels).stages, models.assembler(["length", *vecs])]


def purchase_encoded(encoders: list, data: DataFrame, *keep: str) -> DataFrame:
    """``data`` as model input. The numbers of the levels are written once, as a fit and its scores read
    them several times; the one-hot vectors are made of them where they are read, as they take up more."""
    from pyspark.ml import PipelineModel
    numbered = encoders[0].transform(data.select(*keep, "length", *_CAT))
    written = materialize(numbered.select(*keep, "length", *[F.col(f"{c}__idx").cast("int").alias(f"{c}__idx") for c in _CAT]))
    return PipelineModel(encoders[1:]).transform(written).select(*keep, "features")


def purchase_forest(num_trees: int = 100, max_features: int = 20, seed: int = 42):
    return models.forest_classifier([], "purchased", num_trees, max_features, seed=seed)[-1]


def finance(original_order: DataFrame, next_order: DataFrame, last_assort: DataFrame,
            next_assort: DataFrame, ship_cost: float = 0.60) -> DataFrame:
    """Profit = receipts - (loan + next order) and the Yes/No decision (C2 finance, A1, A3, U1, J2, X10).

    One plan: both orders unioned and averaged per product (one row per product),
    joined to both assortments; every total is a global aggregate.
    """
    spend = F.col("quantity_purchased") * F.col("cost_to_buy")
    loan = original_order.agg(F.sum(spend).alias("loan_amount"))
    nxt = next_order.agg(F.sum(spend).alias("next_order_amount"))
    per_product = (joins.union_all([original_order, next_order]).groupBy("product_id")
                   .agg(F.avg("cost_to_buy").alias("cost_to_buy"), F.avg("retail_value").alias("retail_value")))
    assort = joins.union_all([last_assort.select("customer_id", "product_id", "purchased"),
                              next_assort.select("customer_id", "product_id", "purchased")])
    recv = assort.join(per_product, "product_id", "left").withColumn(
        "amount_received", X.if_else(F.col("purchased") == 1, F.col("retail_value") - ship_cost, F.lit(-2 * ship_cost)))
    received = recv.agg(F.sum("amount_received").alias("amount_received"))
    out = attach_scalars(attach_scalars(loan, nxt), received)
    profit = F.col("amount_received") - (F.col("loan_amount") + F.col("next_order_amount"))
    return (out.withColumn("profit", profit)
            .withColumn("decision", F.when(F.col("profit") >= 0, "Yes").otherwise("No")))


def repay_decision(spark: SparkSession, sf: str, threshold: float = 0.48, num_trees: int = 100,
                   seed: int = 42) -> DataFrame:
    """Purchase model on last month -> scored next month -> finance decision."""
    from pyspark.ml import PipelineModel

    train = spread(materialize(purchase_model_frame(spark, sf, "last").select("purchased", "length", *_CAT)))
    encoders = purchase_encoders(train.select(*_CAT).distinct())
    model = purchase_forest(num_trees, seed=seed).fit(purchase_encoded(encoders, train, "purchased"))
    nxt = PipelineModel([*encoders, model]).transform(purchase_model_frame(spark, sf, "next"))
    scored = models.with_score(nxt).withColumn("purchased", X.threshold_label("score", threshold))
    # the merged frame can hold a pair once per matching genre: one flag per pair
    flags = scored.groupBy("customer_id", "product_id").agg(F.max("purchased").alias("purchased"))
    next_assort = flags.join(S.assortment(spark, sf, "next"), ["customer_id", "product_id"], "right")
    next_assort = next_assort.withColumn("purchased", F.coalesce("purchased", F.lit(0)))
    return finance(S.purchase_order(spark, sf, "last"), S.purchase_order(spark, sf, "next"),
                   S.assortment(spark, sf, "last"), next_assort)


def purchase_thresholds(spark: SparkSession, sf: str, num_trees: int = 100, test_fraction: float = 0.25,
                        seed: int = 42) -> DataFrame:
    """Hold-out metrics of the purchase model by threshold (C2 model metrics: E7-E9):
    confusion counts, accuracy, false-positive and false-negative rate at 0.1..0.9."""
    data = purchase_model_frame(spark, sf, "last").withColumn("__row", F.xxhash64("customer_id", "product_id", "genre"))
    data = sampling.hash_split(data, ["__row", "customer_id", "product_id"], test_fraction, seed)
    data = spread(materialize(data.select("split", "purchased", "length", *_CAT)))
    encoders = purchase_encoders(data.where(F.col("split") == "train").select(*_CAT).distinct())
    coded = purchase_encoded(encoders, data, "split", "purchased")
    model = purchase_forest(num_trees, seed=seed).fit(coded.where(F.col("split") == "train"))
    scored = models.with_score(model.transform(coded.where(F.col("split") == "test")))
    return evaluate.threshold_sweep(scored, "purchased", "score")


def purchase_validation(spark: SparkSession, sf: str, folds: int = 5, num_trees: int = 10,
                        seed: int = 42) -> DataFrame:
    """AUC per stratified fold of the purchase model."""
    from concurrent.futures import ThreadPoolExecutor

    keys = ["__row", "customer_id", "product_id"]
    frame = purchase_model_frame(spark, sf, "last").withColumn("__row", F.xxhash64("customer_id", "product_id", "genre"))
    frame = materialize(frame.select(*keys, "purchased", "length", *_CAT))
    data = sampling.stratified_folds(frame, "purchased", keys, folds, seed)
    data = spread(materialize(data.select("fold", "purchased", "length", *_CAT)))
    levels = materialize(data.groupBy("fold", *_CAT).agg(F.count(F.lit(1)).alias("n")))
    encoders = [purchase_encoders(levels.where(F.col("fold") != k)) for k in range(folds)]
    # folds whose training rows have the same levels, as they mostly have, share the model input
    known = [encoders[k][0].labelsArray for k in range(folds)]
    coded = {}
    for k in range(folds):
        if known.index(known[k]) == k:
            coded[k] = purchase_encoded(encoders[k], data, "fold", "purchased")
    inputs = [coded[known.index(known[k])] for k in range(folds)]
    width = 1 + sum(len(x) + 1 for x in known[0])
    at_once = models.together(levels.agg(F.sum("n")).first()[0] or 0, width + num_trees, folds)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        fitted = list(pool.map(lambda k: purchase_forest(num_trees, seed=seed).fit(inputs[k].where(F.col("fold") != k)), range(folds)))
    parts = [models.with_score(m.transform(inputs[k].where(F.col("fold") == k))).select("fold", "purchased", "score")
             for k, m in enumerate(fitted)]
    scores = materialize(joins.union_all(parts))
    return materialize(evaluate.auc(scores, "purchased", "score", "fold"))


# ------------------------------------------------------------------ C3 A/B report

AB_METRICS = ("shopping_pageviews", "total_pageviews", "log_total_pageviews", "ad_clicks", "shares",
              "bottom_of_page_reached")


def ab_long(first_visits: DataFrame, metrics: Sequence[str] = AB_METRICS) -> DataFrame:
    """(user, device, variant, metric, value): every metric becomes an outer key,
    so one job tests all metrics on both devices."""
    fv = first_visits.withColumn("log_total_pageviews", F.log("total_pageviews"))
    st = F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    return fv.select("user_id", "device_type", "variant", st.alias("metric", "value"))


def ab_report(first_visits: DataFrame) -> DataFrame:
    """Kruskal-Wallis, pairwise Mann-Whitney (Holm), Conover (Holm), Levene and
    Brown-Forsythe, residual normality and the paired signed-rank test, per
    device and metric, as one long table (C3).

    The visits are read once: every test runs on the frequency table
    (device, metric, variant, value) -> n, written to the shared checkpoint
    folder. Its size is bounded by distinct metric values, not by visits.
    """
    long = ab_long(first_visits)
    scope = ["device_type", "metric"]
    freq = materialize(long.where(F.col("value").isNotNull())
                       .groupBy(*scope, "variant", "value").agg(F.count(F.lit(1)).alias("n")))
    pairs = materialize(first_visits.where(F.col("variant") == "top_and_bottom")
                        .groupBy("device_type", "bottom_related_link_clicks", "top_related_link_clicks")
                        .agg(F.count(F.lit(1)).alias("n")))
    cols = ["test", "device_type", "metric", "comparison", "statistic", "df", "p_value", "p_adjusted"]
    kw = htest.kruskal(freq, "variant", "value", scope, weight="n").select(
        F.lit("kruskal_wallis").alias("test"), *scope, F.lit("all").alias("comparison"),
        F.col("h").alias("statistic"), F.col("df").cast("double").alias("df"), "p_value",
        F.col("p_value").alias("p_adjusted"))
    mw = htest.holm(htest.mann_whitney(freq, "variant", "value", scope, weight="n"), "p_value", scope, "p_adjusted",
                    tiebreak=["group_a", "group_b"]).select(
        F.lit("mann_whitney").alias("test"), *scope, F.concat_ws(" vs ", "group_a", "group_b").alias("comparison"),
        F.col("z").alias("statistic"), F.lit(None).cast("double").alias("df"), "p_value", "p_adjusted")
    cn = htest.conover(freq, "variant", "value", scope, weight="n").select(
        F.lit("conover").alias("test"), *scope, F.concat_ws(" vs ", "group_a", "group_b").alias("comparison"),
        F.col("t").alias("statistic"), F.col("df").cast("double").alias("df"), "p_value", "p_adjusted")
    lev = []
    for center, name in (("mean", "levene"), ("median", "brown_forsythe")):
        lev.append(htest.levene(freq, "variant", "value", scope, center, weight="n").select(
            F.lit(name).alias("test"), *scope, F.lit("all").alias("comparison"), F.col("f").alias("statistic"),
            F.col("df1").cast("double").alias("df"), "p_value", F.col("p_value").alias("p_adjusted")))
    norm = htest.residual_moments(freq, "value", "variant", scope, weight="n").select(
        F.lit("residual_jarque_bera").alias("test"), *scope, F.lit("all").alias("comparison"),
        F.col("jarque_bera").alias("statistic"), F.lit(2.0).alias("df"), "p_value", F.col("p_value").alias("p_adjusted"))
    sr = htest.signed_rank(pairs, "bottom_related_link_clicks", "top_related_link_clicks", "device_type",
                           weight="n").select(
        F.lit("signed_rank").alias("test"), "device_type", F.lit("related_link_clicks").alias("metric"),
        F.lit("bottom vs top").alias("comparison"), F.col("z").alias("statistic"),
        F.lit(None).cast("double").alias("df"), "p_value", F.col("p_value").alias("p_adjusted"))
    return joins.union_all([kw.select(*cols), mw.select(*cols), cn.select(*cols), *[x.select(*cols) for x in lev],
                            norm.select(*cols), sr.select(*cols)])


# ------------------------------------------------------------------ C4 loan study

def clean_loans(loans: DataFrame) -> DataFrame:
    """Status grouping and filter, engineered features, rare categories (C4 cleaning:
    X3 X4 X7 X9 X11 X15 N13 F4 F6)."""
    keep = list(S.DEFAULT_STATUSES) + list(S.PAID_STATUSES)
    return (loans.where(F.col("loan_status").isin(keep))
            .select("id",
                    X.group_values("loan_status", {"Default": S.DEFAULT_STATUSES, "Fully Paid": S.PAID_STATUSES})
                    .alias("loan_status"),
                    X.digits_from_text("emp_length").alias("emp_length"),
                    "purpose", "addr_state",
                    X.collapse_rare("home_ownership", ["AUTOMOBILE", "BUILDING"]).alias("home_ownership"),
                    "annual_inc", "dti", "revol_bal",
                    X.log10_1p("annual_inc").alias("log_annual_inc"),
                    X.log10_1p("revol_bal").alias("log_revol_bal"),
                    X.round_half_even(F.col("dti") / 100 * F.col("annual_inc") / 12, 0).alias("total_monthly_debt"),
                    X.year_diff(X.parse_date("apply_date", "MM/dd/yyyy"),
                                X.parse_date("earliest_cr_line", "M/d/yyyy")).alias("age_credit")))


_LOAN_NUM = ["emp_length", "log_annual_inc", "dti", "log_revol_bal", "total_monthly_debt", "age_credit"]
_LOAN_CAT = ["home_ownership", "purpose"]


def loan_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Model frame: median-imputed, standardised numerics plus one-hot columns; label ``default``."""
    cl = materialize(clean_loans(S.loans(spark, sf)))  # medians, levels and scales read it several times
    cl = prep.impute(cl, ["emp_length", "annual_inc", "log_annual_inc", "total_monthly_debt"], "median")
    cl = cl.withColumn("default", (F.col("loan_status") == "Default").cast("int"))
    cols = list(_LOAN_NUM)
    for c in _LOAN_CAT:
        lv = prep.levels_of(cl, c)
        cl = prep.one_hot_columns(cl, c, lv)
        cols += [f"{c}_{v}" for v in lv]
    cl = prep.standardise(cl, _LOAN_NUM)
    return materialize(cl.select("id", "default", *cols)), cols


def loan_study(spark: SparkSession, sf: str, seed: int = 42, forest_trees: int = 40,
               gbt_trees: int = 100, parallelism: int = 9) -> DataFrame:
    """Three models x three balancing schemes (none, under-, over-sampling), and forests and boosted
    trees on data filled up by SMOTE -> AUC on train and test (C4).

    The eleven fits are independent Spark jobs submitted from a thread pool (as
    ``CrossValidator(parallelism=...)`` does), and all AUCs come from
    one rank aggregate scoped by (model, scheme, split).
    """
    from concurrent.futures import ThreadPoolExecutor

    data, cols = loan_features(spark, sf)
    # cut the lineage (orders x customers x nations, imputation, scaling) once;
    # every fit and every resampling below reads the written table
    split = spread(materialize(sampling.stratified_split(data, "default", "id", 0.2, seed)))
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    schemes = {"none": train, "undersample": spread(materialize(sampling.undersample(train, "default", "id", seed))),
               "oversample": spread(materialize(sampling.oversample(train, "default", "id", seed))),
               "smote": spread(materialize(smote.smote(train, "default", cols, "id", seed=seed).select("default", *cols)))}
    size = {sc: frame.count() for sc, frame in schemes.items()}  # the penalty is by the rows of the fit
    specs = {"logistic": lambda sc: models.logistic(cols, "default", size[sc]),
             "random_forest": lambda sc: models.forest_classifier(cols, "default", 2 * forest_trees if sc == "smote" else forest_trees, None,
                                                                 max_depth=10, seed=seed),
             "gradient_boosting": lambda sc: models.gbt(cols, "default", gbt_trees, 3, 0.1, seed)}
    jobs = [(sc, name) for sc in schemes for name in specs if (sc, name) != ("smote", "logistic")]
    with ThreadPoolExecutor(max_workers=models.together(max(size.values()), len(cols) + forest_trees, parallelism)) as pool:
        fitted = list(pool.map(lambda j: models.fit_pipeline(schemes[j[0]], specs[j[1]](j[0])), jobs))
    scored = []
    for (sc, name), m in zip(jobs, fitted):
        for part, frame in (("train", schemes[sc]), ("test", test)):
            scored.append(models.with_score(m.transform(frame)).select(
                F.lit(name).alias("model"), F.lit(sc).alias("scheme"), F.lit(part).alias("split"), "default", "score"))
    scores = materialize(joins.union_all(scored))
    return materialize(evaluate.auc(scores, "default", "score", ["model", "scheme", "split"]))


def loan_validation(spark: SparkSession, sf: str, folds: int = 5, seed: int = 42, forest_trees: int = 40,
                    gbt_trees: int = 100, parallelism: int = 5) -> DataFrame:
    """AUC of the three loan models on each stratified fold of the training data, fitted on the other
    folds (C4 validation: E6, R3): model, fold, n_pos, n_neg, auc."""
    from concurrent.futures import ThreadPoolExecutor

    data, cols = loan_features(spark, sf)
    train = materialize(sampling.stratified_split(data, "default", "id", 0.2, seed).where(F.col("split") == "train").drop("split"))
    train = spread(materialize(sampling.stratified_folds(train, "default", "id", folds, seed)))
    size = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a fold
    whole = sum(size.values())
    specs = {"logistic": lambda k: models.logistic(cols, "default", whole - size.get(k, 0)),
             "random_forest": lambda k: models.forest_classifier(cols, "default", forest_trees, None, max_depth=10, seed=seed),
             "gradient_boosting": lambda k: models.gbt(cols, "default", gbt_trees, 3, 0.1, seed)}
    jobs = [(name, k) for name in specs for k in range(folds)]
    with ThreadPoolExecutor(max_workers=models.together(whole, len(cols) + forest_trees, parallelism)) as pool:
        fitted = list(pool.map(lambda j: models.fit_pipeline(train.where(F.col("fold") != j[1]), specs[j[0]](j[1])), jobs))
    scored = [models.with_score(m.transform(train.where(F.col("fold") == k))).select(F.lit(name).alias("model"), "fold", "default", "score")
              for (name, k), m in zip(jobs, fitted)]
    scores = materialize(joins.union_all(scored))
    return materialize(evaluate.auc(scores, "default", "score", ["model", "fold"]))


# ------------------------------------------------------------------ C5 regression study

def regression_study(spark: SparkSession, sf: str, seed: int = 42) -> DataFrame:
    """OLS weight ~ height on a 90/10 split, test metrics, repeated hold-out,
    per-gender lines, t-test, and the model with gender added (C5)."""
    d = S.dogs(spark, sf).withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    d = sampling.hash_split(d, "row_key", 0.1, seed, method="affine").withColumn(
        "sex", X.replace_values("gender", {"male": 1, "female": 0}))
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    rows = []
    fit = models.ols(train, "weight", ["height"])
    st = fit.stats()
    m_test = evaluate.regression_metrics(fit.predict(test), "weight", "prediction").first()
    rows += [("ols", "r2_train", st["r2"]), ("ols", "rmse_train", st["rmse"]),
             ("ols", "r2_test", m_test["r2"]), ("ols", "rmse_test", m_test["rmse"]),
             ("ols", "slope", float(fit.coef[1])), ("ols", "intercept", float(fit.coef[0]))]
    fit2 = models.ols(train, "weight", ["height", "sex"])
    st2 = fit2.stats()
    m2 = evaluate.regression_metrics(fit2.predict(test), "weight", "prediction").first()
    rows += [("ols_gender", "r2_train", st2["r2"]), ("ols_gender", "rmse_train", st2["rmse"]),
             ("ols_gender", "r2_test", m2["r2"]), ("ols_gender", "rmse_test", m2["rmse"])]
    hold = holdout_rmse(d.drop("split"), seed).agg(F.avg("rmse")).first()[0]
    rows.append(("holdout", "mean_rmse", float(hold)))
    for r in summary.regression_lines(d, "height", "weight", "gender").collect():
        rows.append((f"line_{r['gender']}", "slope", float(r["slope"])))
        rows.append((f"line_{r['gender']}", "r", float(r["r"])))
    tt = htest.t_test(d, "gender", "weight").first()
    rows += [("t_test", "t", float(tt["t"])), ("t_test", "p_value", float(tt["p_value"]))]
    return spark.createDataFrame(rows, "section string, metric string, value double")


def holdout_rmse(d: DataFrame, seed: int = 42, replicates: int = 10, test_fraction: float = 0.1) -> DataFrame:
    """Repeated hold-out RMSE of weight ~ height (R7, E3): all replicates fitted
    in one grouped aggregate (closed-form simple regression per replicate)."""
    rep = sampling.replicate_splits(d, "row_key", replicates, test_fraction, seed, method="affine")
    x, y = F.col("height"), F.col("weight")
    fits = (rep.where(F.col("split") == "train").groupBy("replicate")
            .agg(F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0")))
    te = rep.where(F.col("split") == "test").join(F.broadcast(fits), "replicate")
    e = y - (F.col("b0") + F.col("b1") * x)
    return te.groupBy("replicate").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n_test"))


# ------------------------------------------------------------------ C6 sales study

def sales_study(spark: SparkSession, sf: str, top: int = 10) -> DataFrame:
    """Coverage, top and bottom products, buyer buckets (C6) as one long table
    (section, item, value). Rules are reported by the basket queries."""
    from tessera.operators import profile
    sales, prod, lines = S.sales(spark, sf), S.products(spark, sf), S.product_sales(spark, sf)
    tot = lines.groupBy("product_id").agg(F.sum("quantity").alias("quantity")).join(prod, "product_id")
    cov = profile.coverage(lines.select("product_id").join(prod.select("product_id"), "product_id", "left_semi"),
                           prod, "product_id")
    parts = [cov.select(F.lit("coverage").alias("section"), F.lit("pct_used").alias("item"),
                        F.col("pct_used").alias("value"))]
    parts.append(tot.orderBy(F.desc("quantity"), "product_id").limit(top).select(
        F.lit("top").alias("section"), F.concat_ws(":", F.col("product_id").cast("string"), "product_name").alias("item"),
        F.col("quantity").alias("value")))
    parts.append(tot.orderBy("quantity", "product_id").limit(top).select(
        F.lit("bottom").alias("section"), F.concat_ws(":", F.col("product_id").cast("string"), "product_name").alias("item"),
        F.col("quantity").alias("value")))
    per_member = sales.groupBy("member_id").agg(F.sum("quantity").alias("quantity"))
    lab = (per_member.groupBy("quantity").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("label", X.count_bucket("quantity")).groupBy("label").agg(F.sum("n").alias("n")))
    parts.append(summary.with_share(lab, "n").select(F.lit("buyer_bucket_pct").alias("section"),
                                                     F.col("label").alias("item"), F.col("pct").alias("value")))
    return joins.union_all(parts).withColumn("value", F.round("value", 6))
