"""SimHash, decontamination, language id, quality and packing against brute force on small
tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate, langid, packing, quality, simhash
from tessera.llm.common import save
from tessera.llm.components import connected_components
from tessera.llm.tokens import WordBpe, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_words string, row string, found int"


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}", "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = ["one two three four five", "One TWO three four five", None, "", "  \t\n", "solo", "a b", "Ünï çödé wörds hére now",
         " ".join(f"w{i}" for i in range(20_000)), "one two three four five", "x\x0by\x0cz\x1cq"]


def brute_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute_components(words, bound):
    words, left, out = sorted(set(words)), set(words), {}
    for w in words:
        if w in left:
            todo, left = [w], left - {w}
            while todo:
                x = todo.pop()
                out[x] = w
                near = {y for y in left if (x ^ y).bit_count() <= bound}
                left -= near
                todo += near
    return out


def test_fingerprints_and_components(spark):
    got = {r["doc_id"]: r for r in simhash.simhash_components(table(spark, TEXTS)).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(TEXTS)}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r["fingerprint"] for i, r in got.items()}
    roots = brute_components(fps.values(), 2)
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(roots[f], i)
    assert {i: least[roots[f]] for i, f in fps.items()} == {i: r["component_id"] for i, r in got.items()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in docs.select("doc_id", "text").collect()}
    roots, least = brute_components(fps.values(), 2), {}
    for i, f in sorted(fps.items()):
        least.setdefault(roots[f], i)
    assert got == {i: (f, least[roots[f]]) for i, f in fps.items()}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.lists(st.integers(0, 63), max_size=40), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_gray_index_finds_exactly_the_links(base, flips, bound):
    words = set(base)
    for i, b in enumerate(flips):
        words.add(sorted(words)[i % len(words)] ^ (1 << b))
    words = np.array(sorted(words), np.uint64)
    u, v = simhash.linked(words, bound)
    want = brute_components([int(w) for w in words], bound)
    groups = defaultdict(set)
    for w, r in want.items():
        groups[r].add(w)
    label = {int(w): int(w) for w in words}
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        label[a] = b
    found = defaultdict(set)
    for w, r in label.items():
        found[r].add(w)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_split_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = {0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)}
    fps = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "fp long")
    for limit in (10_000, 8):
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        links = simhash.fingerprint_links(fps, 2)
        roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
        sizes = sorted(np.unique([roots.get(f["fp"], f["fp"]) for f in fps.collect()], return_counts=True)[1])
        assert sizes == sorted(np.unique(list(brute_components(words, 2).values()), return_counts=True)[1])


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}, 501: 500}


def test_dedup_keeps_one_of_each_group(spark):
    docs = table(spark, TEXTS).unionByName(spark.createDataFrame([(None, "solo", None, None, None, None, None), (0, TEXTS[0], "en", "s0", "x", "y", 1)], DOCS))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    want = {r["component_id"] for r in simhash.simhash_components(table(spark, TEXTS)).collect()}
    # the row without an id repeats a text of the table, so it goes: exactly one row a class
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 0
    assert simhash.drop_near_duplicates(table(spark, TEXTS).limit(0)).count() == 0


def test_dedup_of_repeated_and_null_ids(spark, tmp_path):
    """One row a class, whatever the ids: the ids of both texts repeat, and rows repeat whole."""
    a, b = "one text that is long enough to be told", "quite another set of words in its place"
    rows = [(5, a), (5, b), (3, b), (7, a), (None, a), (None, "third words"), (None, "third words"), (9, None), (9, ""), (5, a)]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, path string, file int")
    docs.repartition(4).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for got in (simhash.drop_near_duplicates(stored, stored=True), simhash.drop_near_duplicates(docs)):
        assert got.columns == docs.columns
        out = sorted((r["text"] or "", r["doc_id"] or 0) for r in got.collect())
        assert out == [("", 9), (a, 5), (b, 3), ("third words", 0)]


def test_dedup_moves_no_text(spark):
    """The plan that keeps the rows reads the table once and has no exchange."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = simhash.drop_near_duplicates(docs, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


# --- decontamination ---------------------------------------------------------------------

def norm(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, bench, k=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = norm(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, items = norm(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=repr)


LONG = " ".join(f"t{i}" for i in range(30))
BENCH = [(1, LONG), (2, "Short Item here"), (12, "t5 t6 t7 t8 t9 t10 t11 t12 t13 t14"), (3, ""), (4, None), (5, "***"), (None, "null item of four"), (6, "É one-word"),
         (7, "lone")]
CASES = ["clean text of its own", "before " + LONG.upper() + " after", "a SHORT, item; HERE b", None, "", "...", "É one word É", "é one word",
         "t5 t6 t7 t8 t9 t10 t11 t12 t13 t14 gap t5 t6", "null item of four", "x " * 3000 + LONG + " y" * 3000, "alone", "lone"]


@pytest.mark.parametrize("joined", [False, True])
def test_contamination_against_brute_force(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(decontaminate, "MAX_SET_WINDOWS", 0)
    docs, bench = table(spark, CASES), spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert got == brute_contamination(enumerate(CASES), BENCH)
    clean = {d for d, _, hit, _ in got if not hit}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert all(cut[d] == CASES[d] for d in clean) and cut[1] == "before after" and cut[2] == "a b"


def test_contamination_of_empty_tables(spark):
    docs, bench = table(spark, CASES), spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(CASES)


# --- learned filters ---------------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    from tessera.llm.queries import op2_language_id
    sf = "/root/testdata/sf0.01"
    got = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, lang, None, None, None, None) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("ko te ngeru", "mi")] * 5
        + [(None, "en"), ("", None), ("123 !!", "en"), ("the dog " * 50_000, None)])], DOCS)
    model = langid.learn(docs)
    assert sorted(x for f in model.families for x in f) == ["de", "en", "fr", "mi"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id", "lang"]).collect()}
    assert [got[i]["lang_pred"] for i in (20, 21, 22, 23)] == ["und", "und", "und", "en"]
    assert all(got[i]["lang_pred"] == got[i]["lang"] for i in range(20))
    kept = langid.keep_known(docs, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 21
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_quality_on_held_out_documents(spark):
    from tessera.llm.queries import op7_compression_quality
    sf = "/root/testdata/sf0.01"
    got = op7_compression_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    bad = [r["score"] for r in held if not r["quality"]]
    good = [r["score"] for r in held if r["quality"]]
    assert np.mean([[g > b for g in good] for b in bad]) >= 0.95


def test_quality_edge_cases(spark):
    docs = table(spark, ["good words here"] * 3 + [None, "", "z" * 300_000])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = [r["score"] for r in quality.score(docs, model, ["doc_id", "found"]).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for s in got)
    alone = quality.learn(docs, labels.limit(0))
    assert not alone.weights and quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


# --- packing -----------------------------------------------------------------------------

def check_packing(rows, docs, length):
    """Each id once, sequences without gaps, all full but the last."""
    enc = WordBpe(vocabulary_path(), exact=True)
    ids = {d: [*np.frombuffer(enc._full(t or ""), enc.dtype).tolist(), 2] for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, want in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    total = sum(map(len, ids.values()))
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == min(length, total - s * length)
    assert sorted(by_seq) == list(range(-(-total // length)))
    return by_seq


def test_packing_round_trip_and_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = packing.pack(docs)
    rows = out.collect()
    given_ = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by_seq = check_packing(rows, given_, 4096)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    whole = defaultdict(int)
    for r in rows:
        whole[source[r["doc_id"]]] += r["length"]
    total = sum(whole.values())
    for s, pieces in by_seq.items():
        sent, size = defaultdict(int), sum(r["length"] for r in pieces)
        for r in pieces:
            sent[source[r["doc_id"]]] += r["length"]
        if size == 4096:
            assert all(abs(sent[k] - 4096 * n / total) < 2 for k, n in whole.items())
    seqs = packing.sequences(out).collect()
    assert sum(r["n_tokens"] for r in seqs) == total and all(len(r["ids"]) == 4 * r["n_tokens"] for r in seqs)


def test_packing_edge_cases(spark):
    texts = [None, "", "hello world", "a " * 9000, "hello world"]
    docs = spark.createDataFrame([(i, t, "en", [None, "s", "big", "big", "tiny"][i], "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    check_packing(packing.pack(docs, length=64).collect(), list(enumerate(texts)), 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_targets_until_a_source_is_dry(spark):
    docs = spark.createDataFrame([(i, "word " * 200, "en", "ab"[i % 2 if i < 20 else 0], "x", "y", 1) for i in range(40)], DOCS)
    rows = packing.pack(docs, length=128, targets={"a": 0.5, "b": 0.5}).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 128)
    first = sum(r["length"] for r in rows if r["sequence_id"] < 10 and (r["doc_id"] >= 20 or r["doc_id"] % 2 == 0))
    assert abs(first - 640) <= 20


# --- the pipeline ------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = save(stage(spark, docs, sf), "stage")
        assert docs.columns == cols
        after = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items())
        if name == "near_dedup":
            fps = {i: brute_fp(r["text"]) for i, r in before.items()}
            roots, least = brute_components(fps.values(), 2), {}
            for i, f in sorted(fps.items()):
                least.setdefault(roots[f], i)
            assert set(after) == set(least.values())
        if name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, _, hit, _ in brute_contamination([(i, r["text"]) for i, r in before.items()], bench) if not hit}
    check_packing(cp.STAGES[-1][1](spark, docs, sf).collect(), [(i, r["text"]) for i, r in after.items()], 4096)


def test_sha_of_items(spark):
    from tessera.llm.queries import op5_decontamination
    got = op5_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert all((r["n_hit"] > 0) == r["contaminated"] for r in got)
    assert any(r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
