"""The heavy studies on the smallest tables: their rows, ranges and what must hold between them."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tessera.plans import studies


def rows(spark, name):
    return [r.asDict() for r in E.queries()[name](spark, SF_SMALL).collect()]


def test_loan_study_has_all_arms(spark):
    got = studies.loan_study(spark, SF_SMALL, forest_trees=5, gbt_trees=5).collect()
    arms = {(r["model"], r["scheme"], r["split"]) for r in got}
    want = {(m, s, p) for m in ("logistic", "random_forest", "gradient_boosting") for s in ("none", "undersample", "oversample", "smote")
            for p in ("train", "test")} - {("logistic", "smote", p) for p in ("train", "test")}
    assert arms == want and all(0 <= r["auc"] <= 1 for r in got)
    train = {(r["model"], r["scheme"]): r for r in got if r["split"] == "train"}
    for scheme in ("undersample", "oversample", "smote"):
        r = train["random_forest", scheme]
        assert r["n_pos"] == r["n_neg"]
    test = [(r["n_pos"], r["n_neg"]) for r in got if r["split"] == "test"]
    assert len(set(test)) == 1  # nothing synthetic is tested on


def test_loan_validation_covers_every_row_once(spark):
    got = studies.loan_validation(spark, SF_SMALL, forest_trees=5, gbt_trees=5).collect()
    assert {(r["model"], r["fold"]) for r in got} == {(m, k) for m in ("logistic", "random_forest", "gradient_boosting") for k in range(5)}
    for m in ("logistic", "random_forest", "gradient_boosting"):
        mine = [r for r in got if r["model"] == m]
        assert max(r["n_pos"] for r in mine) - min(r["n_pos"] for r in mine) <= 1
    assert len({sum(r["n_pos"] + r["n_neg"] for r in got if r["model"] == m) for m in ("logistic", "random_forest")}) == 1


def test_feature_ranking_and_lists(spark):
    ranking = rows(spark, "feature_ranking")
    methods = {r["method"] for r in ranking}
    assert {"Corr", "Lasso", "Random Forest", "avg_scores"} <= methods
    for m in methods - {"avg_scores"}:
        scores = [r["score"] for r in ranking if r["method"] == m]
        assert min(scores) == 0.0 and max(scores) == 1.0
    average = {r["feature"]: r["score"] for r in ranking if r["method"] == "avg_scores"}
    for f, s in average.items():
        assert s == pytest.approx(sum(r["score"] for r in ranking if r["feature"] == f and r["method"] != "avg_scores") / (len(methods) - 1), abs=6e-4)
    lists = rows(spark, "feature_lists")
    assert {r["feature"]: r["value"] for r in lists if r["list"] == "selected"} == {f: s for f, s in average.items() if s > 0}
    assert all(r["value"] < 0.01 for r in lists if r["list"] == "significant")


def test_purchase_validation_and_decision(spark):
    folds = rows(spark, "purchase_validation")
    assert sorted(r["fold"] for r in folds) == list(range(5)) and all(0 <= r["auc"] <= 1 for r in folds)
    (d,) = rows(spark, "repay_decision")
    assert d["profit"] == pytest.approx(d["amount_received"] - d["loan_amount"] - d["next_order_amount"])
    assert d["decision"] == ("Yes" if d["profit"] >= 0 else "No")
