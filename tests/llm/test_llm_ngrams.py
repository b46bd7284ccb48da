"""Phrase mining, n-gram automata, Elias-Fano tries and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lm, ngrams, phrases
from tessera.llm.elias_fano import EliasFano, Level, Trie
from tessera.llm.ngrams import Automaton, Dealt, Levels, windows
from tessera.llm.queries import op12_collocations, op13_lm_scoring

SF_SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


# --- automata ----------------------------------------------------------------------------

def counted(levels: list[Levels]) -> dict:
    automaton, _ = Automaton.union(levels)
    return {tuple(p): int(w) for _, paths, weights in automaton.paths() for p, w in zip(paths.tolist(), weights, strict=True)}


@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=1, max_size=4), st.integers(1, 5), st.integers(1, 4), st.sets(st.integers(1, 6)))
@settings(max_examples=150, deadline=None)
def test_union_of_dealt_windows_counts_every_ngram(texts, order, ranges, hot):
    """Number i has label 2 i, or 2 i + 1 if hot; a 0 ends windows."""
    labels = np.array([0, *(2 * i + (i in hot) for i in range(1, 7))])
    want, found, where = Counter(), [[] for _ in range(ranges)], {}
    for text in texts:
        for i in range(len(text)):
            for k in range(1, order + 1):
                gram = tuple(text[i:i + k])
                if len(gram) == k and 0 not in gram:
                    want[tuple(labels[list(gram)].tolist())] += 1
        w = windows(np.array(text, np.int64), order, 7)
        some = w.cols[0] > 0
        if some.any():
            cols, weights = [c[some] for c in w.cols], w.weights[some]
            dealt = phrases._deal([*cols, *[np.zeros(len(weights), np.int64)] * (5 - order)], weights, labels, ranges)
            for r, part in dealt.blobs():
                found[r].append(Levels.from_bytes(part.to_bytes()))
    got = Counter()
    for r, parts in enumerate(found):
        for gram, n in counted(parts).items():
            assert where.setdefault(gram, r) == r  # one range has all of an n-gram
            got[gram] += n
    assert got == want


def test_windows_stop_after_the_end():
    w = windows(np.array([2, 5, 6, 2, 7, 2]), 3, 8, last=2)
    rows = [tuple(int(c[r]) for c in w.cols) for r in w.row]
    assert rows == [(2, 5, 6), (5, 6, 2), (6, 2, 0), (2, 7, 2), (7, 2, 0), (2, 0, 0)]


def test_compose_gives_the_weights_of_known_paths():
    rows = np.array([[1, 2, 0], [1, 3, 2], [2, 0, 0]]).T
    have = Dealt(list(rows), np.array([5, 7, 9]), np.arange(4) * 2, 1)
    ask = Dealt([np.array([1, 1, 3]), np.array([3, 1, 0]), np.array([2, 0, 0])], np.ones(3, np.int64), np.arange(4) * 2, 1, np.ones(3, bool))
    table = Automaton.union([dict(have.blobs())[0]])[0]
    found = table.compose(dict(ask.blobs())[0])
    assert found[2][ask.state(2)[0]] == 7 and found[1][ask.state(1)[1]] == 0 and found[0][ask.state(0)[2]] == 0


# --- phrases -----------------------------------------------------------------------------

def mined(docs, least, top):
    n, f, out = Counter(), {}, []
    for lang, text in docs:
        lang, text = lang or "und", (text or "").translate(LOWER)
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(zip(*(w[i:] for i in range(k)), strict=False))
    for lang, c in f.items():
        found, gone = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, set()
        for p, a in found.items():
            gone |= {q for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (q := p[i:j]) != p and a >= c[q]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts_of(seed, n, words=12):
    rng = np.random.default_rng(seed)
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n"]
    return ["".join(f"{'Ab'[int(rng.random() < 0.5)]}w{int(rng.integers(words) * rng.random())}{signs[rng.integers(len(signs))]}" for _ in range(rng.integers(80))) for _ in range(n)]


@pytest.mark.parametrize("hot", [10, 10**9])
def test_phrases_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngrams, "HOT_WORDS", hot)
    monkeypatch.setattr(ngrams, "RANGE_WORDS", 300)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    monkeypatch.setattr(phrases, "RANK_ROWS", 20)
    docs = [("en", t) for t in texts_of(1, 60)] + [("de", t) for t in texts_of(2, 30)] + [(None, t) for t in texts_of(3, 30)]
    docs += [("en", None), ("en", ""), ("fr", "..."), ("en", docs[0][1]), ("xx", "alone " * 7), ("en", "é " * 9 + "\x00 z")] * 3
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, n int, phrase string").repartition(3)
    for top in (7, None):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=3, top=top).collect())
        assert got == mined(docs, 3, top or 10**9) and len(got) > 20
    assert phrases.collocations(df.limit(0), least=3).count() == 0
    assert phrases.collocations(df, least=10**6).count() == 0


def test_phrases_of_the_whole_table(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op12_collocations(spark, SF_SMALL).collect()) == mined(docs, phrases.LEAST, phrases.TOP)


def test_scores_pass_64_bits():
    """Whole numbers of any size: 1000 a n passes 2^63 here."""
    levels = Levels([np.array([2]), np.array([4])], [np.array([10**10]), np.array([10**10])], [np.array([1])])
    assert Automaton.of(levels).paths()[1][2].tolist() == [10**10]
    assert 1000 * 10**10 * 10**12 // (10**10 * 10**10) == 10**5


# --- Elias-Fano tries --------------------------------------------------------------------

@given(st.lists(st.integers(0, 10**12), max_size=60), st.lists(st.integers(0, 10**12), min_size=1, max_size=20), st.data())
@settings(max_examples=150, deadline=None)
def test_elias_fano(values, asked, data):
    values = np.sort(np.array(values, np.int64))
    parts = EliasFano.of(values).parts()
    ef, end = EliasFano.read(b"x" * 8 + b"".join(parts), 8)
    assert end == 8 + sum(map(len, parts))
    assert ef.at(np.arange(len(values))).tolist() == values.tolist()
    begin = np.array([data.draw(st.integers(0, len(values))) for _ in asked])
    stop = np.array([data.draw(st.integers(int(b), len(values))) for b in begin])
    want = [int(b + np.searchsorted(values[b:s], x)) for x, b, s in zip(asked, begin, stop, strict=True)]
    assert ef.successor(np.array(asked), begin, stop).tolist() == want


@given(st.lists(st.sets(st.integers(0, 300), max_size=12), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_labels_relative_to_their_context(contexts):
    labels = np.array([x for c in contexts for x in sorted(c)], np.int64)
    level = Level.of(labels, np.array([len(c) for c in contexts]), np.zeros((len(labels), 1), np.uint8))
    at = np.cumsum([0, *(len(c) for c in contexts)])
    for i, c in enumerate(contexts):
        want = [int(at[i]) + sorted(c).index(x) if x in c else -1 for x in range(302)]
        assert level.find(np.full(302, i), np.arange(302)).tolist() == want
    assert level.find(np.array([-1]), np.array([3])).tolist() == [-1]


def test_trie_reads_a_mapped_file(tmp_path):
    seq = np.array([2, *np.random.default_rng(1).integers(3, 40, 4000), 2])
    w = windows(seq, 3, 40, last=2)
    part = dict(Dealt(w.cols, w.weights, np.arange(40) * 2, 1, longest=2).blobs())[0]
    scale = lm.Scale(6.0)
    trie, _, _ = lm.build([part], scale)
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    mapped = Trie.read(np.memmap(tmp_path / "trie", np.uint8, "r"))
    for a, b in zip(lm.query(trie, part), lm.query(mapped, part), strict=True):
        assert np.array_equal(a, b)
    # shares and what is left sum to one after each context (the last end has no word after it)
    left, share = scale.values[lm.query(mapped, part)[0][:, 0]], scale.values[lm.query(mapped, part)[1][:, 0]]
    assert np.allclose((np.bincount(part.parents(1), share) + left)[1:], 1, atol=0.05)


# --- language model ----------------------------------------------------------------------

def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None]


def expected(docs):
    """Rows by the formulas of the module, with unrounded numbers."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for _, held, text in docs:
        if not held:
            s = [None, *tokens(text)]
            c1.update(s[1:])
            c2.update(zip(s, s[1:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    total, kinds = sum(c1.values()), len(c1)
    off = [lm.discounts(np.array([0, *c.values()])) for c in (c2, c3)]
    left = Counter()
    for c, d in zip((c2, c3), off, strict=True):
        for gram, n in c.items():
            left[gram[:-1]] += d[min(n, 3)]
    for i, held, text in docs:
        w, base, score = tokens(text), 0.0, 0.0
        for k, (v, x) in enumerate(zip([None, *w], w, strict=False)):
            p = (c1[x] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p)
            if c1[v]:
                p = (c2[v, x] - off[0][min(c2[v, x], 3)]) / c1[v] + left[v,] / c1[v] * p
            u = w[k - 2] if k > 1 else None
            if k and c2[u, v]:
                p = (c3[u, v, x] - off[1][min(c3[u, v, x], 3)]) / c2[u, v] + left[u, v] / c2[u, v] * p
            score += math.log10(p)
        yield i, held, len(w), sum(c1[x] > 0 for x in w), total, base, score


def assert_scores(got, want, close=0.02):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= close * w[2]


@pytest.mark.parametrize("hot", [20, 10**9])
def test_scores_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngrams, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "SHARD_BYTES", 3000)
    monkeypatch.setattr(lm, "discounts", lambda counts: np.array([0.0, 0.5, 0.75, 1.0]))
    texts = texts_of(5, 80, 30) + [None, "", " \n", "never seen before", "é\x00 Z", "x " * 300, "x " * 300]
    docs = [(i, i % 7 == 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, held boolean, text string, score int").repartition(3)
    got = lm.scores(df, ~F.col("held")).collect()
    # one range and other discounts in the workers, which import the module anew
    monkeypatch.undo()
    assert_scores(got, expected(docs))
    assert lm.scores(df.limit(0), ~F.col("held")).count() == 0


def test_scores_over_many_ranges_and_without_training(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "HOT_WORDS", 30)
    monkeypatch.setattr(ngrams, "RANGE_WORDS", 400)
    monkeypatch.setattr(lm, "SHARD_BYTES", 3000)
    docs = [(i, i % 5 == 0, t) for i, t in enumerate(texts_of(6, 90, 30))]
    df = spark.createDataFrame(docs, "doc_id long, held boolean, text string").repartition(3)
    # each range estimates its own discounts from few n-grams here
    assert_scores(lm.scores(df, ~F.col("held")).collect(), expected(docs), 0.2)
    none = [(i, True, t) for i, _, t in docs]
    assert_scores(lm.scores(df, F.lit(None).cast("boolean")).collect(), expected(none))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = lm.scores(df, F.col("doc_id") == 1).collect()
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [
        (0, True, 3, 3, 7), (1, False, 1, 1, 7), (1, False, 3, 3, 7), (1, False, 3, 3, 7)]


def test_scores_of_the_whole_table(spark):
    docs = [(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0, r["text"])
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = op13_lm_scoring(spark, SF_SMALL).collect()
    assert_scores(got, expected(docs))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
