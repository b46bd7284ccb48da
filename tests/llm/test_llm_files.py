"""Tokens, token files, training order, archives, extraction and search: exact round trips,
brute force, and edge cases."""

import hashlib
import html
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import ann, extract, packing, token_counts, training_order, warc
from tessera.llm.common import new_path
from tessera.llm.dom import Page
from tessera.llm.files import AtomicFile
from tessera.llm.tokens import WordBpe, vocabulary_path

EXACT = WordBpe(vocabulary_path(), exact=True)
FAST = WordBpe(vocabulary_path())
AS_FILE = WordBpe(vocabulary_path(), special_as_text=False)
FRESH = Tokenizer.from_file(vocabulary_path())
DOCS = "doc_id long, text string, name string, ordinal int"
TEXTS = ["Hello, World! It's 2024.", None, "", "a\x1cb c\x85d", "İstanbul ΣΑΣ é ﬁ", "<|endoftext|> x", "日本語 text", "word " * 5000, "Hello, World! It's 2024."]


def ids_of(text):
    return np.frombuffer(EXACT._full(text or ""), EXACT.dtype)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(texts)], DOCS)


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_fast_ids_equal_the_tokenizer(texts):
    ids, at = FAST.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == FAST.tok.encode(t or "", add_special_tokens=False).ids


LATIN = st.text(st.sampled_from("aZÉéßÿƀ'sStTdDmMrRvVeElL 9½²ªµº×÷«»¡¿_-.,!\t\n\x0b\x0c\r"), max_size=60)


@given(st.lists(st.one_of(LATIN, st.none(), st.text(max_size=9)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_pieces_of_latin_text_equal_the_tokenizer(texts):
    for tools in (FAST, AS_FILE):
        ids, at = tools.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == tools.tok.encode(t or "", add_special_tokens=False).ids


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", " ", "\n", "\x1c", "a", "É", "e\u0301", "\u0301", "日本", "'s", "7"]), max_size=12).map("".join))
@settings(max_examples=150, deadline=None)
def test_special_tokens_are_those_of_the_vocabulary_file(text):
    ids, _ = AS_FILE.encode(pa.array([text]))
    assert ids.tolist() == FRESH.encode(text, add_special_tokens=False).ids


def test_packing_keeps_the_ids_of_the_vocabulary_file(spark):
    rows = packing.pack(docs_of(spark, TEXTS), source_col="name").orderBy("sequence_id", "offset").collect()
    for i, t in enumerate(TEXTS):
        want = [*FRESH.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in mine) == np.array(want, "<u4").tobytes()
        assert {r["doc_tokens"] for r in mine} == {len(want)}


def test_token_counts(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(docs_of(spark, TEXTS)).collect()}
    assert got == {i: len(ids_of(t)) for i, t in enumerate(TEXTS)}
    assert token_counts.document_token_counts(docs_of(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "SUPER", 3)
    rng, want = np.random.default_rng(block), []
    folder = new_path(spark, "scan")
    for f in range(3):
        ids = rng.integers(0, 9, 57).astype("<u2") * (rng.random(57) < 0.9).astype("<u2") if f else np.zeros(0, "<u2")
        out = AtomicFile(folder, f"f{f}.bin")
        out.write(ids.tobytes())
        out.commit()
        start = 0
        for k, end in enumerate(np.flatnonzero(ids == 0)):
            want.append((f"f{f}.bin", k, start, end - start, True))
            start = end + 1
        if start < len(ids):
            want.append((f"f{f}.bin", int((ids == 0).sum()), start, len(ids) - start, False))
    got = token_counts.count_tokens(spark, folder, 2, end_id=0, block_bytes=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@given(st.integers(1, 3000), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    x = np.arange(n)
    y = training_order.permute(x, n, key)
    assert sorted(y.tolist()) == x.tolist()
    assert (training_order.permute(y, n, key, inverse=True) == x).all()


def test_training_order_shards(spark):
    docs, folder = docs_of(spark, TEXTS).repartition(3), new_path(spark, "order")
    rows = training_order.materialise(docs, length=128, per_shard=16, folder=folder).orderBy("slot").collect()
    total = len(rows)
    assert [r["slot"] for r in rows] == list(range(total))
    data = list(training_order.read_slots(folder, 0, total, total, 256, 16))
    assert [zlib.crc32(d) for d in data] == [r["ids_crc32"] for r in rows]
    assert list(training_order.read_slots(folder, 37, 5, total, 256, 16)) == data[37:42]
    stream = {}
    for r, d in zip(rows, data, strict=True):
        stream[r["index"]] = np.frombuffer(d, "<u2")[:r["n_tokens"]]
    tokens = np.concatenate([stream[i] for i in range(total)]).tolist()
    found = sorted(tuple(x) for x in _split(tokens, training_order.END_ID))
    assert found == sorted(tuple(ids_of(t).tolist()) for t in TEXTS)
    # a second run finds every shard complete and returns the same
    again = training_order.materialise(docs, length=128, per_shard=16, folder=folder).orderBy("slot").collect()
    assert again == rows
    assert training_order.materialise(docs.limit(0)).count() == 0


def _split(tokens, end):
    out, cur = [], []
    for t in tokens:
        if t == end:
            out.append(cur)
            cur = []
        else:
            cur.append(t)
    return out


# --- archives ----------------------------------------------------------------------------

@given(st.binary(max_size=5000), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_chunked_framing(payload, size):
    assert warc.dechunk(warc.chunked(payload, size)) == payload
    assert warc.dechunk(warc.chunked(payload, size)[:-3]) in (None, payload)


def test_archive_round_trip(spark):
    long = "<p>" + "long é " * 20_000 + "</p>"
    same = "<html>" + "s" * 200
    given_ = [(1, "http://a/x y", same), (2, None, same), (3, "http://c/\r\nWARC-Type: x", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""),
              (7, "u", long), (9, "u", long), (8, "u", "W" * 100), (10, "u", "W" * 100), (None, "u", "no id " * 30), (11, "u", "WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, 1) for r in given_], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for p, _, h in sorted(given_, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        r, prior = got[p], first.setdefault(data, p) if len(data) >= 100 else p
        assert (r["payload_bytes"], r["payload_digest"], r["complete"]) == (len(data), hashlib.sha256(data).hexdigest(), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if prior == p else ("revisit", prior))
    assert len(got) == len(given_)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_revisits_of_repeated_ids(spark):
    """Each row's digest and length are those of its own payload, whatever ids repeat."""
    a, b = "A" * 306, "B" * 406
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, b), (1, a), (4, "x:" * 9000), (4, "y" * 60), (5, "x:" * 9000)]
    pages = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, name string")
    got = warc.archive_round_trip(pages.withColumnRenamed("name", "url")).collect()
    full = lambda h: (len(h), hashlib.sha256(h.encode()).hexdigest())
    key = lambda r: tuple((x is None, x) for x in r)
    assert all(r["complete"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got), key=key) == sorted(
        ((i, *full(h), {a: 1, b: 1, "x:" * 9000: 4}.get(h) if i not in (1, 4) else None) for i, h in rows), key=key)
    text = spark.createDataFrame([("p:1 é", a), ("p:2", a)], "page_id string, html string")
    assert {(r["page_id"], r["refers_to"]) for r in warc.archive_round_trip(text).collect()} == {("p:1 é", None), ("p:2", "p:1 é")}


def test_long_pages_are_put_together(spark):
    """A page of 64 MB: every segment is copied once (a quadratic join would move 130 GB)."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (64 << 20)
    parts = [block[i:i + warc.SEGMENT_BYTES] for i in range(0, len(block), warc.SEGMENT_BYTES)]
    n = len(parts)
    rows = pa.RecordBatch.from_arrays([
        pa.array(["r"] * n), pa.array(range(1, n + 1), pa.int32()), pa.array(["response"] + ["continuation"] * (n - 1)),
        pa.array([None] * n, pa.string()), pa.array([None] * (n - 1) + [len(block)], pa.int64()), pa.array(parts, pa.binary())],
        ["key", "part", "type", "url", "whole", "block"])
    begin = time.perf_counter()
    (got,) = warc._join_segments(iter([rows]))
    assert time.perf_counter() - begin < 5
    assert got.column(4)[0].as_py() and got.column(3)[0].as_buffer().size == len(block)


def test_broken_segments_are_told(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x" * 90)
    a, b, c = block[:50], block[50:100], block[100:]
    whole = "<urn:x-page:1:0>"
    row = lambda part, data, total=None, origin=whole: ("n", "response" if part == 1 else "continuation", whole if part == 1 else f"c{part}", "u",
                                                        None if part == 1 else origin, part, total, None, data)
    schema = warc._RAW
    for rows, ok in (([row(3, c, len(block)), row(1, a), row(2, b), row(2, b)], True), ([row(1, a), row(3, c, len(block))], False),
                     ([row(1, a), row(2, b), row(3, c, len(block) + 1)], False), ([row(2, b, 50)], False), ([row(1, a), row(2, b)], False)):
        got = warc.reassemble(spark.createDataFrame(rows, schema)).collect()
        assert [r["complete"] for r in got] == [ok]
        if ok:
            assert warc.payload_of(got[0]["block"]) == b"x" * 90


def test_read_records_over_any_chunks():
    recs = [([("WARC-Type", "resource"), ("X", "é")], b"a\r\n\r\nb" * k) for k in range(5)]
    data = b"".join(warc.member(warc.record(f, b)) for f, b in recs)
    for step in (1, 7, 1000):
        got = list(warc.read_records(iter([data[i:i + step] for i in range(0, len(data), step)])))
        assert [b for _, b in got] == [b for _, b in recs] and got[0][0]["x"] == "é"


# --- extraction --------------------------------------------------------------------------

def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())


def test_extraction_on_the_table(spark):
    from tessera.llm.queries import op8_html_extraction
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op8_html_extraction(spark, sf).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert np.mean([r["text"] == article(pages[r["page_id"]]) for r in got]) >= 0.99


def test_extraction_of_other_layouts():
    trees, maker = extract.model(), extract._Maker(4711)
    same = 0
    for _ in range(150):
        page = maker.page()
        marked = Page(page)
        kept = [any(maker.MARK in t for n, t, _ in marked.runs if n == i) for i in range(len(marked.parent))]
        want = marked.text(kept).replace(maker.MARK, "")
        same += extract.texts([Page(page.replace(maker.MARK, ""))], trees)[0] == want
    assert same >= 130


def test_extraction_edge_cases(spark):
    cases = [None, "", "   ", "<", "<article", "</p></div>", "<!-- only -->", "<script>var a='</p>'</script>",
             "<nav><a href='#'>home</a></nav><article><h1>T&amp;C</h1><p>One&nbsp;two\n three<br>four. And <i>so</i> on, at some length here.</p></article>",
             "<article>" + "<div>" * 6 + "<p>Deep words are here, in the middle of it.</p>" + "</div>" * 6 + "</article>",
             "<div>" * 3000 + "<p>deeper" + "</div>" * 3000, "<p>" + "long text, and so on. " * 50_000]
    pages = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract.main_text(pages, ["page_id", "url"]).collect()}
    assert [got[i] for i in (0, 1, 2, 6, 7)] == [""] * 5
    assert got[8] == "T&C One two three four. And so on, at some length here."
    assert got[9] == "Deep words are here, in the middle of it."
    assert len(got) == len(cases) and got[11] == ("long text, and so on. " * 50_000).strip()
    assert extract.main_text(pages.limit(0), ["page_id"]).count() == 0


def test_extraction_drops_nothing_by_rule():
    """Hidden wrappers, mathematics and drawings are judged like other elements, adverts within a
    line are told from it, and white space is kept where an inline element ends."""
    trees = extract.model()
    text = lambda page: extract.texts([Page(page)], trees)[0]
    long = "Some long text of an article, with words. And more of them."
    for veil in ('aria-hidden="true"', "hidden", 'style="display:none"'):
        assert text(f"<body><article {veil}><h1>Title</h1><p>{long}</p><p>{long}</p></article></body>") == f"Title {long} {long}"
    assert text(f"<article><p>energy is <math>E = mc2</math> said <object>so</object>. {long}</p></article>") == f"energy is E = mc2 said so. {long}"
    assert text(f"<article><p>foo<b>bar</b>baz <svg><text>lab</text></svg> {long}</p></article>") == f"foobarbaz lab {long}"
    assert text(f'<article><p>{long} <span class="ad">Buy now cheap</span> {long}</p><p>{long}</p></article>') == f"{long} {long} {long}"
    assert text(f'<main><p>foo<span class="main-text">bar</span>baz {long}</p></main>') == f"foobarbaz {long}"
    assert text(f"<form><select><option>one<option>two</select></form><article><p>{long}</p><p>{long}</p></article>") == f"{long} {long}"


def test_decoding_drops_what_lies_in_dropped_elements():
    keep = extract.decode([-1, 0, 1, 1, 0, 4], np.array([0.0, -1.0, 3.0, -2.0, -3.0, 1.0]))
    assert keep.tolist() == [True, True, True, False, False, False]


# --- search ------------------------------------------------------------------------------

def test_search_recall_and_order(spark):
    sf = "/root/testdata/sf0.01"
    from tessera.llm.queries import op1_multiprobe_search
    rows = op1_multiprobe_search(spark, sf).collect()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in data}
    hits = total = 0
    for q in [i for i in x if i % 20 == 0]:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-12 for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        best = sorted((i for i in x if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:20]
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 20
    assert hits / total >= 0.9


def test_search_edge_cases(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (300, [1.0]), (20, same)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(vectors, lambda i: i % 20 == 0, k=20).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and (i < 60 or 100 <= i < 140)}
    assert {r["query_id"] for r in got} == {i for i in good if i % 20 == 0}
    for q in (0, 20, 40):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best = sorted((i for i in good if i != q), key=lambda i: (-round(float(good[q] @ good[i]), 9), i))[:20]
        assert [r["vec_id"] for r in mine] == best
    assert ann.nearest(vectors.limit(0), lambda i: i % 20 == 0).count() == 0


def test_search_with_one_huge_norm_and_probes_that_do_not_reach(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3] *= 1000
    x[4] *= 1e-200
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def recall():
        got = ann.nearest(vectors, lambda i: i % 50 == 0, k=10).collect()
        hits = 0
        for q in range(0, 1500, 50):
            mine = {r["vec_id"] for r in got if r["query_id"] == q}
            assert len(mine) == 10
            scores = x @ x[q]
            hits += len(mine & set([i for i in np.argsort(-scores, kind="stable") if i != q][:10]))
        return hits / 300

    assert recall() >= 0.9
    monkeypatch.setattr(ann, "MAX_PROBES", 8)
    assert recall() == 1
    # queries that the buckets leave short
    monkeypatch.setattr(ann, "fit", lambda sample, total, top, k: ann.Hashes(
        100 * rng.normal(size=(ann.TABLES, 8, 25)), rng.uniform(0, 2, size=(ann.TABLES, 8)), top, 1, 0))
    assert recall() == 1


def test_probes_come_in_the_order_of_their_cost():
    rng = np.random.default_rng(1)
    fraction = rng.random(5)
    cost = {(-1): fraction ** 2, 1: (1 - fraction) ** 2}
    got = [[(f, int(d)) for f, d in enumerate(row) if d] for row in ann.perturbations(fraction, 200)]
    sums = [sum(cost[d][f] for f, d in s) for s in got]
    assert got[0] == [] and sums == sorted(sums) and len({tuple(sorted(s)) for s in got}) == len(got) == 200
    assert len(ann.perturbations(fraction, 10_000)) == 3 ** 5


@pytest.mark.parametrize("m, count", [(1, 3), (2, 9), (3, 27), (8, 300), (12, 500)])
def test_probe_sets_of_any_query(m, count):
    """With all sets wanted there is each one once; with some, few cheaper ones are left out."""
    rng = np.random.default_rng(m)
    for kind, fraction in enumerate((rng.random(m), np.full(m, 0.5), np.zeros(m))):
        got = ann.perturbations(fraction, count)
        cost = np.where(got > 0, (1 - fraction) ** 2, np.where(got < 0, fraction ** 2, 0.0)).sum(1)
        assert len({tuple(r) for r in got.tolist()}) == len(got) == count and not got[0].any() and (np.diff(cost) >= -1e-12).all()
        if m == 8 and not kind:  # an ordinary query
            every = np.array(np.meshgrid(*[[-1, 0, 1]] * m)).reshape(m, -1).T
            best = np.sort(np.where(every > 0, (1 - fraction) ** 2, np.where(every < 0, fraction ** 2, 0.0)).sum(1))[:count]
            assert cost.sum() <= 1.05 * best.sum() + 1e-9


def test_clustered_vectors_are_found_among_few():
    """On vectors with neighbours of their own the probes visit a share of the table that is under a half
    and falls as the table grows, at the same recall."""
    rng = np.random.default_rng(11)
    shares = []
    for n in (1000, 4000, 16000):
        centres = rng.normal(size=(n // 50, 32))
        x = centres[rng.integers(len(centres), size=n)] + 0.15 * rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        made = ann.fit(x[:ann.FIT_ROWS], n, 1.0, 20)
        queries = x[::n // 50]
        seen = ann.visited(made, queries, x)
        best = np.argsort(-(queries @ x.T), axis=1)[:, 1:21]
        assert np.take_along_axis(seen, best, 1).mean() >= 0.9
        shares.append(seen.mean())
    assert shares[0] < 0.5 and shares[0] > shares[1] > shares[2]
