"""Learned filters against plain versions of their decisions, and samples and parts when one id
holds a third of all rows."""

import math
import unicodedata

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import langid, packing, quality

SF = "/root/testdata/sf0.001"


def plain_language(text, model):
    """The decision on one text, word for word from the description."""
    line = " ".join("".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split())
    if not line:
        return "und"
    data = f" {line} ".encode()
    x = np.zeros(langid.DIM)
    for i in range(len(data) - 2):
        a, b, c = data[i:i + 3]
        x[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 20) % (langid.DIM // 2)] += 1
        x[((b * 0x27D4EB2F + c * 0x165667B1) % 2**32 >> 20) % (langid.DIM // 2) + langid.DIM // 2] += 1
    w = model.weights.astype(float)
    m = dict(zip(model.columns, x / max(1, x.sum()) @ w[:-1] + w[-1], strict=True))
    family = max(range(len(model.families)), key=lambda f: m.get((f,), 0.0))
    names = model.families[family]
    votes = {i: [0, 0.0] for i in range(len(names))}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            v = m[family, i, j]
            votes[i if v > 0 else j][0] += 1
            votes[i][1] += math.tanh(v)
            votes[j][1] -= math.tanh(v)
    return names[max(votes, key=lambda i: votes[i])]


def test_language_decisions_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["text"]) for r in langid.predict(docs, model, ["doc_id", "text"]).limit(50).collect()}
    assert all(pred == plain_language(text, model) for pred, text in got.values()) and len(got) == 50


def test_letters_are_those_of_category_l():
    assert langid.normalise("½ ² ① Ⅷ ٣ _ 7") == b""
    assert langid.normalise("A½b ②") == b" a b " and langid.normalise("一二") == " 一二 ".encode()


def test_margins_of_long_texts_equal_their_vector(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(langid.DIM + 1, 3)).astype(np.float32)
    texts = [langid.normalise("".join(rng.choice(list("abcde é"), n))) or b" a " for n in (3, 10, 60, 63, 64, 65, 500, 2, 40)]
    want = np.array([langid.vector(t) @ weights[:-1] + weights[-1] for t in texts])
    assert np.allclose(langid._margins(texts, weights), want, atol=1e-4)


def test_samples_take_ids_not_rows(spark):
    """One id with a third of all rows, and other texts in each, is learned once."""
    rows = [(i, f"the cat {i} and the dog", "en") for i in range(300)] + [(i, f"der Hund {i} und die Katze", "de") for i in range(300, 600)]
    rows += [(7, f"the word number {i}", "en") for i in range(300)] + [(None, "null id", "en")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert langid.learn(docs, sample=250).families == langid.learn(docs.dropDuplicates(["doc_id"]), sample=250).families
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    model = quality.learn(docs, labels, sample=100)
    assert model.weights == quality.learn(docs.repartition(2), labels, sample=100).weights
    with pytest.raises(ValueError):
        langid.predict(docs, langid.learn(docs), ["lang", "text"]).transform(lambda d: langid.predict(d, langid.learn(docs), ["score"]))
    with pytest.raises(ValueError):
        quality.score(docs.withColumn("score", F.lit(1)), model, ["score"])


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc def", f"l{min(i, 3)}") for i in range(9)] + [(20, "x y", "l0")], "doc_id long, text string, lang string")
    assert sorted(x for f in langid.learn(docs).families for x in f) == ["l0", "l3"]


def test_quality_scores_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tools = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False,
                                      write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def plain(text):
        data = (text or "").encode()
        if not data:
            return model.prior
        parts = [data[i:i + quality.PIECE] for i in range(0, len(data), quality.PIECE)]
        good, bad = ([len(t.compress(p)) for p in parts] for t in tools)
        least = min(1.0, *((b - g) / (len(p) + 16) for g, b, p in zip(good, bad, parts, strict=True)))
        x = [(sum(bad) - sum(good)) / (sum(bad) + sum(good)), (sum(bad) - sum(good)) / (len(data) + 16), least, sum(good) / (len(data) + 16)]
        return 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, [*x, 1.0], strict=True))))

    got = quality.score(docs, model, ["text"]).limit(50).collect()
    assert len(got) == 50 and all(r["score"] == pytest.approx(plain(r["text"]), abs=1e-9) for r in got)


def test_packing_parts_of_null_and_repeated_ids(spark, monkeypatch):
    """Rows without an id, or with one id, are dealt over the parts of their queue."""
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 500)
    rows = [(None, f"null words {i} " * 5, "a") for i in range(100)] + [(7, f"same id {i} " * 5, "a") for i in range(100)] + [(i, "own id", "b") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs, length=128).collect()
    ends = sorted((r["sequence_id"] * 128 + r["offset"], r["length"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0
    whole = sum(r["length"] for r in got)
    assert whole == ends[-1][0] + ends[-1][1] and sum(r["start"] == 0 for r in got) == len(rows)
    plan = packing.pack(docs, length=128)._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in plan and "ids" in plan
