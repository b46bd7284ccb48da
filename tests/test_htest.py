"""Rank and variance tests against brute-force implementations on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dist
from tessera.operators import htest
from tessera.operators.rank import exact_quantiles


def midranks(values):
    order = sorted(range(len(values)), key=lambda i: values[i])
    ranks = [0.0] * len(values)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and values[order[j + 1]] == values[order[i]]:
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def tie_sum(values):
    from collections import Counter
    return sum(t ** 3 - t for t in Counter(values).values())


def brute_kw(groups):
    allv = [v for g in groups.values() for v in g]
    r = midranks(allv)
    n = len(allv)
    pos, s = 0, 0.0
    for g in groups.values():
        rs = sum(r[pos:pos + len(g)])
        s += rs * rs / len(g)
        pos += len(g)
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie_sum(allv) / (n ** 3 - n))
    return h


def brute_mw(x, y):
    allv = x + y
    r = midranks(allv)
    n1, n2, n = len(x), len(y), len(allv)
    w = sum(r[:n1]) - n1 * (n1 + 1) / 2
    d = w - n1 * n2 / 2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_sum(allv) / (n * (n - 1))))
    return w, (d - math.copysign(0.5, d) if d else 0.0) / sigma


def _frame(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


TIES_SOME = {"a": [1, 2, 2, 3], "b": [2, 3, 3, 5], "c": [0, 1, 1, 4]}


def test_kruskal_matches_brute_force(spark):
    got = htest.kruskal(_frame(spark, TIES_SOME), "g", "v").first()
    assert got["h"] == pytest.approx(brute_kw(TIES_SOME), rel=1e-12)
    assert got["df"] == 2
    assert got["p_value"] == pytest.approx(dist.chi2_sf(brute_kw(TIES_SOME), 2), rel=1e-9)


def test_kruskal_random_with_scope(spark):
    rnd = random.Random(7)
    rows, ref = [], {}
    for s in ("x", "y"):
        groups = {g: [rnd.randint(0, 6) for _ in range(rnd.randint(5, 30))] for g in ("g1", "g2", "g3", "g4")}
        ref[s] = brute_kw(groups)
        rows += [(s, g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "s string, g string, v double")
    got = {r["s"]: r["h"] for r in htest.kruskal(df, "g", "v", "s").collect()}
    for s in ref:
        assert got[s] == pytest.approx(ref[s], rel=1e-10)


def test_all_ties_gives_null(spark):
    got = htest.kruskal(_frame(spark, {"a": [1, 1], "b": [1, 1, 1]}), "g", "v").first()
    assert got["h"] is None


def test_mann_whitney_pairs(spark):
    got = {(r["group_a"], r["group_b"]): r for r in htest.mann_whitney(_frame(spark, TIES_SOME), "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        w, z = brute_mw([float(v) for v in TIES_SOME[a]], [float(v) for v in TIES_SOME[b]])
        assert r["w"] == pytest.approx(w)
        assert r["z"] == pytest.approx(z, rel=1e-10)


def test_signed_rank_drops_zeros(spark):
    pairs = [(3, 1), (2, 2), (5, 1), (1, 4), (0, 0), (7, 2), (2, 1), (3, 3), (1, 2)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = htest.signed_rank(df, "a", "b").first()
    d = [a - b for a, b in pairs if a != b]
    r = midranks([abs(x) for x in d])
    v = sum(rr for rr, x in zip(r, d) if x > 0)
    n = len(d)
    zc = v - n * (n + 1) / 4
    sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_sum([abs(x) for x in d]) / 48)
    assert got["n"] == n
    assert got["v_stat"] == pytest.approx(v)
    assert got["z"] == pytest.approx((zc - math.copysign(0.5, zc)) / sigma)


def test_holm_monotone(spark):
    ps = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r["i"]: r["p_holm"] for r in htest.holm(df, "p").collect()}
    # sorted: .01*4=.04, .03*3=.09, .04*2=.08 -> running max .09, .2*1=.2
    assert got == pytest.approx({0: 0.04, 2: 0.09, 1: 0.09, 3: 0.2})


def test_levene_and_brown_forsythe(spark):
    groups = {"a": [1, 2, 3, 10], "b": [2, 2, 3, 3, 4], "c": [0, 5, 9]}
    df = _frame(spark, groups)
    for center in ("mean", "median"):
        got = htest.levene(df, "g", "v", center=center).first()
        zs = {}
        for g, vs in groups.items():
            c = sum(vs) / len(vs) if center == "mean" else sorted(vs)[len(vs) // 2] if len(vs) % 2 else \
                (sorted(vs)[len(vs) // 2 - 1] + sorted(vs)[len(vs) // 2]) / 2
            zs[g] = [abs(v - c) for v in vs]
        allz = [z for v in zs.values() for z in v]
        n, k = len(allz), len(zs)
        zbar = sum(allz) / n
        between = sum(len(v) * (sum(v) / len(v) - zbar) ** 2 for v in zs.values())
        within = sum((z - sum(v) / len(v)) ** 2 for v in zs.values() for z in v)
        assert got["f"] == pytest.approx((n - k) / (k - 1) * between / within, rel=1e-10)


def test_t_test_pooled(spark):
    a, b = [5.0, 6.0, 7.0, 9.0], [1.0, 2.0, 2.5]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    got = htest.t_test(df, "g", "v").first()
    ma, mb = sum(a) / 4, sum(b) / 3
    va = sum((x - ma) ** 2 for x in a) / 3
    vb = sum((x - mb) ** 2 for x in b) / 2
    sp2 = (3 * va + 2 * vb) / 5
    t = (ma - mb) / math.sqrt(sp2 * (1 / 4 + 1 / 3))
    assert got["t"] == pytest.approx(t)
    assert got["df"] == 5
    assert got["p_value"] == pytest.approx(dist.t_two_sided(t, 5))


def test_exact_quantiles_match_linear_interpolation(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5, 8.0, 13.0]) + rnd.random() * (rnd.random() < 0.3) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", probs, n_buckets=8).collect()}
    s = sorted(vals)
    for p in probs:
        pos = p * (len(s) - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        assert got[p] == pytest.approx(s[lo] + (s[hi] - s[lo]) * (pos - lo), rel=1e-12)


def test_residual_moments(spark):
    groups = {"a": [1.0, 2.0, 6.0], "b": [3.0, 3.5, 10.0, 1.0]}
    df = _frame(spark, groups)
    got = htest.residual_moments(df, "v", "g").first()
    e = [v - sum(vs) / len(vs) for vs in groups.values() for v in vs]
    m2 = sum(x * x for x in e) / len(e)
    m3 = sum(x ** 3 for x in e) / len(e)
    assert got["skewness"] == pytest.approx(m3 / m2 ** 1.5)
    assert got["n"] == 7


def test_f_scores(spark):
    rows = [(float(i), float(i % 3), float(2 * i + (i % 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    got = {r["feature"]: r for r in htest.f_scores(df, "y", ["x1", "x2"]).collect()}
    r = got["x1"]["r"]
    assert got["x1"]["f"] == pytest.approx(r * r / (1 - r * r) * 38)
    assert 0 <= got["x2"]["p_value"] <= 1


def test_frequency_table_path_equals_raw_rows(spark):
    rnd = random.Random(17)
    rows = [(rnd.choice("xy"), rnd.choice("abc"), float(rnd.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string, g string, v double")
    freq = df.groupBy("s", "g", "v").count()
    for fn, key in ((htest.kruskal, "h"), (htest.conover, "t"), (htest.mann_whitney, "z")):
        a = sorted(r[key] for r in fn(df, "g", "v", "s").collect())
        b = sorted(r[key] for r in fn(freq, "g", "v", "s", weight="count").collect())
        assert a == pytest.approx(b, rel=1e-12)
    for center in ("mean", "median"):
        a = sorted(r["f"] for r in htest.levene(df, "g", "v", "s", center).collect())
        b = sorted(r["f"] for r in htest.levene(freq, "g", "v", "s", center, weight="count").collect())
        assert a == pytest.approx(b, rel=1e-10)
    a = sorted(r["jarque_bera"] for r in htest.residual_moments(df, "v", "g", "s").collect())
    b = sorted(r["jarque_bera"] for r in htest.residual_moments(freq, "v", "g", "s", weight="count").collect())
    assert a == pytest.approx(b, rel=1e-9)


def test_cumulative_counts_exact_under_skew(spark):
    """One value holds a third of the rows, the rest is continuous."""
    from tessera.operators.rank import cumulative_counts
    rnd = random.Random(23)
    vals = [5.0] * 300 + [rnd.lognormvariate(0, 2) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ties = df.groupBy("v").count()
    got = {r["v"]: r["below"] for r in cumulative_counts(ties, [], "v", "count", n_buckets=16, sub_buckets=4).collect()}
    for v, below in got.items():
        assert below == sum(1 for x in vals if x < v)


def test_one_group_and_empty_inputs(spark):
    one = _frame(spark, {"a": [1, 2, 3, 3]})
    r = htest.kruskal(one, "g", "v").first()
    assert r["k"] == 1 and r["df"] == 0 and r["h"] == pytest.approx(0.0, abs=1e-12)
    assert htest.mann_whitney(one, "g", "v").count() == 0
    empty = spark.createDataFrame([], "g string, v double")
    assert htest.kruskal(empty, "g", "v").count() <= 1
    from tessera.operators import profile
    d = profile.describe_numeric(empty, ["v"]).first()
    assert d["count"] == 0 and d["median"] is None


def test_degenerate_sizes_do_not_raise(spark):
    tiny = _frame(spark, {"a": [1.0], "b": [2.0]})
    assert htest.kruskal(tiny, "g", "v").count() == 1
    assert htest.conover(tiny, "g", "v").count() == 1
    assert htest.mann_whitney(tiny, "g", "v").count() == 1
    assert htest.t_test(tiny, "g", "v").first()["t"] is None
    single = _frame(spark, {"a": [1.0]})
    assert htest.kruskal(single, "g", "v").first()["h"] is None


def test_residual_ks_matches_brute_force(spark):
    rnd = random.Random(31)
    rows = [(g, rnd.gauss(m, 1.0) ** 3) for g, m in (("a", 0.0), ("b", 1.0)) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = htest.residual_ks(df, "v", "g").first()
    e = []
    for g in ("a", "b"):
        vs = [v for gg, v in rows if gg == g]
        m = sum(vs) / len(vs)
        e += [v - m for v in vs]
    n = len(e)
    mu = sum(e) / n
    sd = math.sqrt(sum((x - mu) ** 2 for x in e) / (n - 1))
    s = sorted(e)
    d = max(max((i + 1) / n - dist.norm_cdf((x - mu) / sd), dist.norm_cdf((x - mu) / sd) - i / n)
            for i, x in enumerate(s))
    assert got["n"] == n
    assert got["ks_statistic"] == pytest.approx(d, rel=1e-9)


def test_exact_quantiles_with_scope_weights_and_skew(spark):
    import numpy as np
    rnd = random.Random(41)
    rows = []
    for s in ("x", "y"):
        rows += [(s, 7.0)] * 200 + [(s, rnd.lognormvariate(1, 1.5)) for _ in range(300 if s == "x" else 37)]
    df = spark.createDataFrame(rows, "s string, v double")
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {(r["s"], r["p"]): r["q"] for r in exact_quantiles(df, "v", probs, "s", n_buckets=4).collect()}
    freq = df.groupBy("s", "v").count()
    got_w = {(r["s"], r["p"]): r["q"] for r in exact_quantiles(freq, "v", probs, "s", weight="count").collect()}
    for s in ("x", "y"):
        vals = np.array([v for ss, v in rows if ss == s])
        for p in probs:
            want = float(np.percentile(vals, p * 100))
            assert got[(s, p)] == pytest.approx(want, rel=1e-12)
            assert got_w[(s, p)] == pytest.approx(want, rel=1e-12)
