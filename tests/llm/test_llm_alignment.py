"""Alignment of two tokenizers against a brute-force version, texts of any kind, rare pairs."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment
from tessera.llm.alignment import BothTokenizers, align_texts, components
from tessera.llm.queries import op11_token_alignment
from tessera.llm.tokens import vocabulary_path

SF_SMALL = "/root/testdata/sf0.001"

TOOLS = BothTokenizers(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  a", "a  b\n\n  c", "x\n  y", "日本語 text　x", "<|endoftext|> <s> <0x41>", "a▁b", "\n", "\t\t a",
       "a\r\nb", " a \n", "é ﬁ", "a\x00b", "1234  5", "x" * 3000, "the end", "the end"]


def brute(text):
    """Groups of a text as (ids of A, ids of B), by the ends of all tokens."""
    if not text or not (ids := TOOLS.whole(text)):
        return []
    out, at = [], [0, 0]
    ends = [np.cumsum(s[i]).tolist() for s, i in zip((TOOLS.size_a, TOOLS.size_b), ids, strict=True)]
    for e in sorted(set(ends[0]) & set(ends[1])):
        both = []
        for side in (0, 1):
            stop = ends[side].index(e, at[side]) + 1
            both.append(ids[side][at[side]:stop].tolist())
            at[side] = stop
        out.append(both)
    return out


def line(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(texts):
    groups = [brute(t) for t in texts]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for g in groups:
        n = [(count[a[-1], b[-1]], best[b[-1]]) for a, b in g]
        yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(x == y for x, y in n),
               sum(x for x, _ in n), hashlib.sha256(line(g).encode()).hexdigest() if g else "")


def result(df):
    return [tuple(r[1:]) for r in sorted(df.collect(), key=lambda r: r[0])]


@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab \n\t.é1", max_size=40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_groups_of_any_text(texts):
    for text, row in zip(texts, align_texts(TOOLS, texts), strict=True):
        want = brute(text)
        assert row.groups == len(want)
        assert (row.digest.hexdigest() if want else "") == (hashlib.sha256(line(want).encode()).hexdigest() if want else "")


def test_whole_text_needs_the_same_bytes():
    assert TOOLS.whole("a▁b") is None and TOOLS.whole("a b") is not None


@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
@settings(deadline=None)
def test_pointers_end_at_common_ends(a, b):
    gap = sum(a) - sum(b)
    a, b = a + [-gap] * (gap < 0), b + [gap] * (gap > 0)
    last_a, last_b = components(np.array(a), np.array(b))
    common = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
    assert np.cumsum(a)[last_a].tolist() == common == np.cumsum(b)[last_b].tolist()


@pytest.mark.parametrize("hot", [0, 40, 10**6])
def test_documents_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "COUNT_ROWS", 300)
    monkeypatch.setattr(alignment, "BLOCK", 60)
    texts = [*ODD, "one word after another. " * 40, "one word"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, row int")
    assert result(alignment.aligned_documents(docs)) == list(expected(texts))
    assert alignment.aligned_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs, ["n_a"])


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in alignment.aligned_documents(docs).collect())
    assert got == [(0, 2, 6), (1, 1, 1), (1, 2, 6), (1, 2, 6)]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    docs.sort(key=lambda r: r["doc_id"])
    assert result(op11_token_alignment(spark, SF_SMALL)) == list(expected([r["text"] for r in docs]))
