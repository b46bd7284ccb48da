"""Basket mining and text operators against brute force."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import basket, text

PLANTED = {1: "abc", 2: "abc", 3: "ab", 4: "ac", 5: "bcd", 6: "d", 7: "abcd", 8: "", 9: "a", 10: "cd"}


def _brute(baskets, min_support):
    n = len(baskets)
    items = sorted({i for b in baskets for i in b})
    sup = {}
    for k in range(1, len(items) + 1):
        for s in combinations(items, k):
            c = sum(1 for b in baskets if set(s) <= b)
            if c / n >= min_support:
                sup[frozenset(s)] = c / n
    rules = {}
    for s, v in sup.items():
        if len(s) < 2:
            continue
        for k in range(1, len(s)):
            for a in combinations(sorted(s), k):
                a = frozenset(a)
                c = s - a
                conf = v / sup[a]
                rules[(tuple(sorted(a)), tuple(sorted(c)))] = (v, conf, conf / sup[c])
    return sup, rules


def test_itemsets_and_rules_with_multi_item_consequents(spark):
    rows = [(b, it, 1) for b, s in PLANTED.items() for it in s] + [(8, "z", 0)]
    df = spark.createDataFrame(rows, "basket long, item string, qty int")
    bk = basket.baskets(df, "basket", "item", "qty")
    assert bk.count() == 10  # the basket with only a zero quantity stays, empty
    fi = basket.frequent_itemsets(bk, 0.2)
    sup, rules = _brute([set(s) for s in PLANTED.values()], 0.2)
    got = {frozenset(r["items"]): r["support"] for r in fi.collect()}
    assert got == pytest.approx(sup)
    rr = basket.association_rules(fi, "lift", 0.0).collect()
    got_rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): (r["support"], r["confidence"], r["lift"])
                 for r in rr}
    assert set(got_rules) == set(rules)
    for k, v in rules.items():
        assert got_rules[k] == pytest.approx(v)
    assert any(len(c) == 2 for _, c in got_rules)  # multi-item consequents are present


def test_rule_matrix_and_strong_rules(spark):
    rows = [(b, it) for b, s in PLANTED.items() for it in s]
    bk = basket.baskets(spark.createDataFrame(rows, "basket long, item string"), "basket", "item")
    r = basket.association_rules(basket.frequent_itemsets(bk, 0.2), "lift", 0.8)
    strong = basket.strong_rules(r, 0.7).collect()
    assert all(x["confidence"] > 0.7 for x in strong)
    confs = [x["confidence"] for x in strong]
    assert confs == sorted(confs, reverse=True)
    m = basket.rule_matrix(r).collect()
    assert {"antecedent", "consequent", "confidence"} <= set(m[0].asDict())


def test_tokens_and_bigrams(spark):
    names = [(1, "The Red Widget & Blue Bolt"), (2, "of the"), (3, ""), (4, "Blue bolt, red widget")]
    df = spark.createDataFrame(names, "id long, name string")
    t = text.tokenize(df, "name", stop_words=["the", "of"])
    toks = {r["id"]: r["tokens"] for r in t.collect()}
    assert toks[1] == ["red", "widget", "blue", "bolt"]
    assert toks[2] == [] and toks[3] == []
    within = {(r["first"], r["second"]): r["n"] for r in text.bigram_counts(t).collect()}
    assert within == {("red", "widget"): 2, ("widget", "blue"): 1, ("blue", "bolt"): 2, ("bolt", "red"): 1}
    cross = {(r["first"], r["second"]): r["n"] for r in text.bigram_counts(t, key="id", cross_boundary=True).collect()}
    # one stream over texts 1 and 4 (2 and 3 have no tokens): adds (bolt, blue)
    stream = toks[1] + toks[4]
    expect = {}
    for a, b in zip(stream, stream[1:]):
        expect[(a, b)] = expect.get((a, b), 0) + 1
    assert cross == expect


def test_default_stop_words_are_spark_list(spark):
    t = text.tokenize(spark.createDataFrame([("the cat and a hat",)], "s string"), "s")
    assert t.first()["tokens"] == ["cat", "hat"]


def test_doc_bigrams_all_reads_every_document(spark, tmp_path):
    from tessera.plans.catalog import REGISTRY
    rows = [(1, "The cat sat", "en"), (2, "Über die Straße", "de"), (3, "Über die Straße", None), (4, "mañana the día", "es"),
            (5, "the été", "xx"), (6, None, "en"), (7, "кот и пёс", "ru"), (8, "x", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["first"], r["second"]): r["n"] for r in REGISTRY["doc_bigrams_all"].build(spark, str(tmp_path)).collect()}
    assert got == {("cat", "sat"): 1, ("über", "straße"): 1, ("über", "die"): 1, ("die", "straße"): 1, ("mañana", "the"): 1,
                   ("the", "día"): 1, ("the", "été"): 1, ("кот", "и"): 1, ("и", "пёс"): 1}
