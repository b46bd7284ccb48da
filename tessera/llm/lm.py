"""Language-model scores of whole texts from Elias-Fano n-gram tries.

The model is a trigram model, smoothed by absolute discounts of one, two and more occurrences
(Chen and Goodman), each order interpolated with the shorter one:

    p(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | v)   = (c(vw) - D(c(vw))) / c(v) + left(v) p(w)
    p(w | u v) = (c(uvw) - D(c(uvw))) / c(uv) + left(uv) p(w | v)

where left() is what the discounts of all words after a context leave to the shorter one. Tries
hold the first terms and the weights left, each as one byte on a logarithmic scale. Every range of
prefixes has a trie of its own, with discounts from its own counts of counts; the n-grams of each
shard are looked up there once, and the shard adds up its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import save
from tessera.llm.elias_fano import Level, Trie
from tessera.llm.ngrams import Automaton, Dealt, Levels

ORDER = 3
#: Added to the count of every word.
ADD = 0.1
#: The discount where too few n-grams occur once or twice to estimate it.
DISCOUNT = 0.75
#: Bytes of text held for a shard at most, but for a longer text.
SHARD_BYTES = 12 << 20

SCORES = "`{}` {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
KINDS = ngrams.byte_kinds(b" \t\n\x0b\x0c\r")
# Labels: no word, a word never seen in training, the end of a text (and what stands before it);
# odd ones do not end a prefix.
NONE, UNKNOWN, END = 0, 3, 5


class Scale:
    """Numbers from 10^-``decades`` to 1 as bytes from 255 to 1, evenly by their logarithm; 0 is zero."""

    def __init__(self, decades: float):
        self.step = decades / 254
        self.values = np.append(0.0, 10.0 ** -(np.arange(255) * self.step))

    def code(self, x: np.ndarray) -> np.ndarray:
        some = x > 0
        at = np.round(-np.log10(np.where(some, x, 1.0)) / self.step)
        return np.where(some, 1 + np.clip(at, 0, 254), 0).astype(np.uint8)


def _shards(docs: DataFrame, id_col: str, text_col: str, usable: Column) -> DataFrame:
    """One row a shard: its texts' ids and whether they train, its words with their counts in
    training texts, and the words in turn as numbers from 1, a 0 after each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ngrams.shard_numbers()
        for b in parts:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            start, size = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or (size and size + len(t) > SHARD_BYTES):
                    if i > start:
                        yield shard(next(numbers), b.column(0).slice(start, i - start), b.column(1).slice(start, i - start), texts[start:i])
                    start, size = i, 0
                size += len(t or b"")

    def shard(number: int, ids: pa.Array, train: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words, code, text, _ = ngrams.split_words(texts, KINDS)
        train = train.to_numpy(zero_copy_only=False)
        n = np.bincount(code, train[text].astype(np.float64), len(words)).astype(np.int64)
        seq = np.insert(code + 1, np.searchsorted(text, np.arange(len(texts)), "right"), 0).astype("<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), ngrams.one_list(ids), ngrams.one_list(pa.array(train)), ngrams.one_list(words.cast(pa.string())),
             ngrams.one_list(pa.array(n)), pa.array([len(n)]), pa.array([len(seq)]), pa.array([seq.tobytes()], pa.binary())],
            ["shard", "keys", "train", "words", "counts", "n_words", "n_tokens", "seq"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(usable, F.lit(False)), F.col(f"`{text_col}`").cast("string"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"shard long, keys array<{kind}>, train array<boolean>, words array<string>, counts array<long>, n_words long, n_tokens long, seq binary")


class _Sequence:
    """The tokens of a shard: numbers of their labels with one end before the first text and after
    each, counts of the labels, and the windows."""

    def __init__(self, seq: bytes, train: list[bool], side: str, shard: int, texts: int):
        ids = np.frombuffer(seq, "<u4")
        label, total = ngrams.labels_of_shard(side, shard)
        local = np.flatnonzero(total)
        local = local[np.argsort(label[local])]
        self.labels = np.append([NONE, UNKNOWN, END], label[local])
        self.counts = np.append([0, 0, texts], total[local])
        number = np.ones(len(label) + 1, np.uint32)
        number[local + 1] = np.arange(3, 3 + len(local))
        number[0] = 2
        self.seq = np.append(2, number[ids]).astype(np.uint32)
        self.ends = np.flatnonzero(self.seq == 2)  # the first is the start
        # a window belongs to the text of its second token
        weight = np.append(np.repeat(np.array(train, np.int64), np.diff(self.ends)), 0)
        self.windows = ngrams.windows(self.seq, ORDER, len(self.labels), weight, 2)


def _dealt(s: _Sequence, ranges: int) -> Dealt:
    return Dealt(s.windows.cols, s.windows.weights, s.labels, ranges, longest=2, ordered=True)


def _asked(shards: DataFrame, side: str, ranges: int, texts: int) -> DataFrame:
    """(range, shard, blob): the n-grams of every shard with their counts in training texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for shard, train, seq in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = _Sequence(seq, train, side, shard, texts)
                out = []
                for r, levels in _dealt(s, ranges).blobs():
                    # contexts of one word come with their count in the corpus
                    levels.weights[0] = s.counts[np.searchsorted(s.labels, levels.labels[0])]
                    out.append((r, levels.to_bytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([shard] * len(out), pa.int64()),
                                                  pa.array([x for _, x in out], pa.binary())], ["range", "shard", "blob"])

    return shards.select("shard", "train", "seq").mapInArrow(run, "range long, shard long, blob binary")


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off n-grams that occur 0, 1, 2 and more times, from how many occur how often."""
    n1, n2, n3, n4 = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
    if not (n1 and n2 and n3):
        return np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 0.98, 1.9, 2.9])


def build(parts: list[Levels], scale: Scale) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of one range from the counts of its shards, n-grams without a count left out, and
    the labels of its hot first words with what they leave to shorter contexts here, in occurrences.

    Codes of a first word: the weight it leaves (a hot word's lies in several ranges: none here); of
    a bigram: its discounted share and the weight it leaves; of a trigram: its discounted share.
    """
    summed, states = Automaton.union(parts)
    for p, m in zip(parts, states, strict=True):
        summed.weights[0][m[0]] = p.weights[0]  # every part has the count of the corpus
    labels, counts, parents, keep = [], [], [], np.ones(1, bool)
    for key, weight in zip(summed.keys, summed.weights, strict=True):
        parent = (key >> np.uint64(32)).astype(np.int64)
        live = (weight > 0) & keep[parent]
        labels.append((key[live] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        parents.append((np.cumsum(keep) - 1)[parent[live]])
        counts.append(weight[live])
        keep = live
    share, left = [None], []
    for depth in range(1, len(labels)):
        off = discounts(counts[depth])[np.minimum(counts[depth], 3)]
        share.append((counts[depth] - off) / counts[depth - 1][parents[depth]])
        left.append(np.bincount(parents[depth], off, len(labels[depth - 1])))
    hot = (labels[0] & 1).astype(bool)
    codes = [[scale.code(np.where(hot, 0.0, left[0] / np.maximum(counts[0], 1)))]]
    for depth in range(1, len(labels)):
        codes.append([scale.code(share[depth])])
        if depth < len(left):
            codes[-1].append(scale.code(left[depth] / counts[depth]))
    sizes = [1, *map(len, labels)]
    levels = [Level.of(x, np.bincount(p, minlength=n), np.stack(c, 1)) for x, p, n, c in zip(labels, parents, sizes, codes, strict=False)]
    return Trie(levels), labels[0][hot], left[0][hot]


def query(trie: Trie, asked: Levels) -> list[np.ndarray]:
    """Codes of the states of an automaton, level by level; a state that the trie lacks has zeros."""
    out, state = [], np.zeros(1, np.int64)
    for depth, labels in enumerate(asked.labels):
        state = trie.levels[depth].find(state[asked.parents(depth)], labels)
        codes = trie.levels[depth].codes
        found = np.zeros((len(labels), codes.shape[1]), np.uint8)
        found[state >= 0] = codes[state[state >= 0]]
        out.append(found)
    return out


def _answers(asked: DataFrame, scale: Scale) -> DataFrame:
    """(shard, range, sizes, codes) from the trie of each range, built and asked in one task, and for
    shard -1 the labels of hot words with what they leave in this range."""

    def run(table: pa.Table) -> pa.Table:
        parts = [Levels.from_bytes(x.as_py()) for x in table.column("blob")]
        trie, hot, left = build(parts, scale)
        trie = Trie.read(trie.to_bytes())
        zip_ = zstandard.ZstdCompressor(level=1)
        out, sizes = [], []
        for p in parts:
            codes = query(trie, p)
            sizes.append([len(c) for c in codes])
            out.append(zip_.compress(b"".join(c.T.tobytes() for c in codes)))
        n = len(out)
        return pa.table({
            "shard": pa.concat_arrays([table.column("shard").combine_chunks(), pa.array([-1])]), "range": pa.array([table.column("range")[0].as_py()] * (n + 1)),
            "sizes": pa.array([*sizes, []], pa.list_(pa.int64())), "codes": pa.array([*out, b""], pa.binary()),
            "hot": pa.array([None] * n + [hot.tolist()], pa.list_(pa.int64())), "left": pa.array([None] * n + [left.tolist()], pa.list_(pa.float64()))})

    return asked.groupBy("range").applyInArrow(
        run, "shard long, range long, sizes array<long>, codes binary, hot array<long>, left array<double>")


def _sums(shards: DataFrame, side: str, hot: dict[int, float], answers: str, ranges: int, total: int, texts: int, distinct: int,
          scale: Scale, id_col: str, kind: str) -> DataFrame:
    """Scores of all texts from the answers to their shard's n-grams."""
    held = shards.sparkSession.sparkContext.broadcast(hot)  # fewer than ngrams.MAX_HOT words

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in range(b.num_rows):
                shard, train, seq = (b.column(i)[row].as_py() for i in (0, 2, 3))
                s = _Sequence(seq, train, side, shard, texts)
                yield _scored(s, ngrams.of_shard(answers, shard), b.column(1)[row].values, train)

    def _scored(s: _Sequence, table: pa.Table, keys: pa.Array, train: list[bool]) -> pa.RecordBatch:
        dealt = _dealt(s, ranges)
        found = [[] for _ in range(4)]
        for i in np.argsort(ngrams.numpy_of(table, "range")):
            one, two, _ = table.column("sizes")[int(i)].as_py()
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(table.column("codes")[int(i)].as_py()), np.uint8)
            for out, x in zip(found, np.split(raw, [one, one + two, one + 2 * two]), strict=True):
                out.append(x)
        left1, share2, left2, share3 = (scale.values[np.concatenate(x)] for x in found)
        left2 = np.where(left2 > 0, left2, 1.0)  # a context never seen leaves all to the shorter one
        left = np.ones(len(s.labels))
        own = left1 > 0
        left[np.searchsorted(s.labels, dealt.labels[0][own])] = left1[own]
        for i in np.flatnonzero((s.labels & 1) & (s.counts > 0)).tolist():
            left[i] = held.value[int(s.labels[i])] / s.counts[i]
        two, three = dealt.state(1), dealt.state(2)
        w, v = s.seq[1:], s.seq[:-1]  # each token and the one before it
        base = (s.counts[w] + ADD) / (total + ADD * (distinct + 1))
        at = s.windows.row[:-1]
        p = share2[two[at]] + left[v] * base
        longer = np.flatnonzero(v[1:] != 2) + 1  # with two tokens before it
        at = s.windows.row[longer - 1]
        if len(at):
            p[longer] = share3[three[at]] + left2[two[at]] * p[longer]
        first = s.ends[:-1]
        sums = lambda x: np.add.reduceat(x, first)
        return pa.RecordBatch.from_arrays([
            keys, pa.array(~np.array(train, bool)), pa.array(np.diff(s.ends).astype(np.int64)),
            pa.array(sums((s.counts[w] > 0).astype(np.int64))), pa.array(np.full(len(first), total, np.int64)),
            pa.array(sums(np.log10(base))), pa.array(sums(np.log10(p)))],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return shards.select("shard", "keys", "train", "seq").mapInArrow(
        run, SCORES.format(id_col, kind))


def _hot(spark: SparkSession, answers: str) -> dict[int, float]:
    """What hot words leave to shorter contexts, summed over all ranges. There are less than
    one for ``HOT_WORDS`` words of the corpus."""
    each = spark.read.parquet(f"{answers}/shard=-1").select(F.inline(F.arrays_zip("hot", "left")))
    return {r["hot"]: r["left"] for r in each.groupBy("hot").agg(F.sum("left").alias("left")).collect()}


def scores(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out`` (not ``usable``; a null condition is
    false), ``n_tokens`` (words of the text, lower-cased A-Z, and one end), ``n_known`` (tokens
    found in usable texts), ``train_tokens`` (all tokens of these), ``base_score`` (log10 by single
    words) and ``score`` (log10 by the trigram model).

    The model learns from all usable texts. Null and empty texts are their end alone, null and
    repeated ids stay as they are, repeated rows count and are scored each, other columns are not
    used. Without usable texts every token is unknown; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shards = save(_shards(docs, id_col, text_col, usable), "lm-shards")
    every = shards.agg(F.count(F.lit(1)).alias("shards"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"),
                       F.sum(F.size(F.filter("train", lambda x: x))).alias("texts")).first()
    if not every["shards"]:
        return docs.sparkSession.createDataFrame([], SCORES.format(id_col, kind))
    side = ngrams.number_words(shards, [], 3, UNKNOWN, "lm-sides")
    sums = {"n": 0, "v": 0}
    if every["words"]:
        sums = docs.sparkSession.read.parquet(f"{side}/shard=-1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    texts = every["texts"]
    total, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    ranges = max(1, every["tokens"] // ngrams.RANGE_WORDS)
    scale = Scale(np.log10(total + 1) + 1.5)
    answers = ngrams.by_shard(_answers(_asked(shards, side, ranges, texts), scale), "lm-answers")
    hot = _hot(docs.sparkSession, answers)
    return _sums(shards, side, hot, answers, ranges, total, texts, distinct, scale, id_col, kind)
