"""Phrase collocation mining with weighted acyclic automata.

Shards of texts build count transducers from their sorted n-grams, ranges of prefixes unite them
and sum the weights, and the parts of every frequent phrase are looked up by composing an
automaton of the parts asked for with the transducer of their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import ngrams
from tessera.llm.common import save
from tessera.llm.ngrams import Automaton, Dealt, Levels

#: The longest phrase.
LONGEST = 5
#: Fewest occurrences of a phrase.
LEAST = 100
#: Phrases of each language in the report.
TOP = 2000
#: Bytes of text held for a shard at most, but for a longer text.
SHARD_BYTES = 16 << 20
#: Phrases that one task of the report ranks first.
RANK_ROWS = 200_000

REPORT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
KINDS = ngrams.byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")


def _shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """One row a shard: its language, words and their counts, and the words in turn as numbers
    from 1, a 0 between pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = ngrams.shard_numbers(), {}, {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            words, code, _, piece = ngrams.split_words(held.pop(lang), KINDS)
            size.pop(lang)
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for a, z in zip([0, *cuts[_splits(cuts, len(code))]], [*cuts[_splits(cuts, len(code))], len(code)], strict=True):
                if a == z:
                    continue
                part, inner = code[a:z], cuts[(cuts > a) & (cuts < z)] - a
                present, local, n = np.unique(part, return_inverse=True, return_counts=True)
                ids = np.insert(local + 1, inner, 0).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([next(numbers)]), pa.array([lang]), ngrams.one_list(words.take(pa.array(present)).cast(pa.string())),
                    ngrams.one_list(pa.array(n)), pa.array([len(n)]), pa.array([z - a]), pa.array([ids.tobytes()], pa.binary())],
                    ["shard", "lang", "words", "counts", "n_words", "n_tokens", "ids"])

        for b in parts:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= SHARD_BYTES:
                    yield from close(lang)
        for lang in list(held):
            yield from close(lang)

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, n_words long, n_tokens long, ids binary")


def _splits(cuts: np.ndarray, n: int) -> np.ndarray:
    """Which cuts between pieces to take so that no shard is much longer than ``SHARD_WORDS``."""
    wanted = np.arange(ngrams.SHARD_WORDS, n, ngrams.SHARD_WORDS)
    at = np.searchsorted(cuts, wanted)
    return np.unique(at[at < len(cuts)])


def _transducers(shards: DataFrame, side: str, ranges: int) -> DataFrame:
    """(lang, range, blob): a shard's n-grams with their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for shard, lang, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seq, (labels, _) = np.frombuffer(data, "<u4"), ngrams.labels_of_shard(side, shard)
                by = np.argsort(labels)
                number = np.zeros(len(by) + 1, np.uint32)
                number[by + 1] = np.arange(1, len(by) + 1)
                labels = np.append(0, labels[by])
                w = ngrams.windows(number[seq], LONGEST, len(labels))
                some = w.cols[0] > 0
                cols, weights = [c[some] for c in w.cols], w.weights[some]
                dealt = _deal(cols, weights, labels, ranges)
                out = [(r, x.to_bytes()) for r, x in dealt.blobs()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([r for r, _ in out], pa.int64()),
                                                  pa.array([x for _, x in out], pa.binary())], ["lang", "range", "blob"])

    return shards.select("shard", "lang", "ids").mapInArrow(run, "lang string, range long, blob binary")


def _deal(cols: list[np.ndarray], weights: np.ndarray, labels: np.ndarray, ranges: int) -> Dealt:
    """Windows by the range of their prefix; n-grams of hot words alone, which are shorter than
    that prefix, by themselves."""
    hot = (labels & 1).astype(bool)
    rows, sums = [cols], [weights]
    for depth in range(1, LONGEST):
        some = np.logical_and.reduce([hot[c] for c in cols[:depth]]) & (cols[depth] > 0)
        head = [c[some] for c in cols[:depth]]
        new = ngrams._changes(head)[-1] if some.any() else np.zeros(0, bool)
        at = np.flatnonzero(new)
        rows.append([c[at] for c in head] + [np.zeros(len(at), cols[0].dtype)] * (LONGEST - depth))
        sums.append(np.add.reduceat(weights[some], at) if len(at) else weights[:0])
    whole = np.repeat([False] + [True] * (LONGEST - 1), [len(s) for s in sums])
    return Dealt([np.concatenate(c) for c in zip(*rows, strict=True)], np.concatenate(sums), labels, ranges, whole)


def _parts(paths: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The distinct parts of phrases by every cut: their numbers by place, for each length and cut
    the rows of both parts, and the label of each number."""
    labels = np.unique(np.concatenate([[0], *(p.ravel() for p in paths)]))
    rows, spans = [], []
    for p in paths:
        p = np.searchsorted(labels, p)
        for k in range(1, p.shape[1]):
            for part in (p[:, :k], p[:, k:]):
                rows.append(np.pad(part, ((0, 0), (0, LONGEST - part.shape[1]))))
            spans.append(len(p))
    cols = list(np.concatenate(rows).T) if rows else [np.zeros(0, np.int64)] * LONGEST
    by = ngrams._order(cols, len(labels))
    cols = [c[by] for c in cols]
    new = ngrams._changes(cols)[-1]
    row = np.empty(len(by), np.int64)
    row[by] = np.cumsum(new) - 1
    cuts, at = [], 0
    for n in spans:
        cuts.append((row[at:at + n], row[at + n:at + 2 * n]))
        at += 2 * n
    return [c[new] for c in cols], cuts, labels


def _asked(automaton: Automaton, ranges: int):
    """What a range asks for: its phrases by length with their counts, and their parts dealt out."""
    phrases = [(path, weight) for depth, path, weight in automaton.paths() if depth > 1]
    cols, cuts, labels = _parts([p for p, _ in phrases])
    dealt = Dealt(cols, np.ones(len(cols[0]), np.int64), labels, ranges, np.ones(len(cols[0]), bool))
    return phrases, cols, cuts, labels, dealt


def _lookup(tables: DataFrame, ranges: int) -> DataFrame:
    """(lang, range, part, weights): the answers to what each range asks, by the range that answers."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lang, src, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                dealt = _asked(Automaton.of(Levels.from_bytes(blob)), ranges)[-1]
                out = [(r, x.to_bytes()) for r, x in dealt.blobs()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(out), pa.string()), pa.array([r for r, _ in out], pa.int64()),
                    pa.array([src] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["lang", "range", "src", "asked"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        counts = Automaton.of(Levels.from_bytes(table.column("blob")[0].as_py())) if table.num_rows else Automaton([], [])
        zip_ = zstandard.ZstdCompressor(level=1)
        found = [zip_.compress(b"".join(x.astype("<i8").tobytes() for x in counts.compose(Levels.from_bytes(a.as_py())))) for a in asked.column("asked")]
        sizes = [[len(x) for x in Levels.from_bytes(a.as_py()).labels] for a in asked.column("asked")]
        return pa.table({"lang": asked.column("lang"), "range": asked.column("src"), "part": asked.column("range"),
                         "sizes": pa.array(sizes, pa.list_(pa.int64())), "weights": pa.array(found, pa.binary())})

    asked = tables.select("lang", "range", "blob").mapInArrow(ask, "lang string, range long, src long, asked binary")
    both = asked.groupBy("lang", "range").cogroup(tables.select("lang", "range", "blob").groupBy("lang", "range"))
    return both.applyInArrow(answer, "lang string, range long, part long, sizes array<long>, weights binary")


def _scores(tables: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """(lang, ids, inside, a, l, r, score) of every phrase with its lowest-scoring cut, and with
    ``inside`` true the parts that are no more frequent than a phrase that holds them."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["lang", "ids", "inside", "a", "l", "r", "score"]
        cols = [[] for _ in names]
        lang, n = table.column("lang")[0].as_py(), table.column("n")[0].as_py()
        phrases, part_cols, cuts, labels, dealt = _asked(Automaton.of(Levels.from_bytes(table.column("blob")[0].as_py())), ranges)
        depths = [[] for _ in range(LONGEST)]
        for i in np.argsort(found.column("part").to_numpy()):
            flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(found.column("weights")[int(i)].as_py()), "<i8")
            for d, x in enumerate(np.split(flat, np.cumsum(found.column("sizes")[int(i)].as_py())[:-1])):
                depths[d].append(x)
        weight = np.zeros(len(part_cols[0]), np.int64)
        for d, x in enumerate(depths):
            rows = np.flatnonzero(dealt.length == d + 1)
            if len(rows):
                weight[rows] = np.concatenate(x)[dealt.state(d)[rows]]
        inside = np.zeros(len(weight), bool)
        at = iter(cuts)
        for path, count in phrases:
            best: list[tuple] = [()] * len(path)
            for k in range(1, path.shape[1]):
                first, rest = next(at)
                # the parts that are shorter by one word
                if k == path.shape[1] - 1:
                    inside[first[100 * count >= 100 * weight[first]]] = True
                if k == 1:
                    inside[rest[100 * count >= 100 * weight[rest]]] = True
                for i, (a, l, r) in enumerate(zip(count.tolist(), weight[first].tolist(), weight[rest].tolist(), strict=True)):
                    score = 1000 * a * n // (l * r)  # whole numbers of any size
                    if not best[i] or score < best[i][0]:
                        best[i] = score, a, l, r
            for ids, (score, a, l, r) in zip(path.tolist(), best, strict=True):
                for c, v in zip(cols, (lang, ids, False, a, l, r, score), strict=True):
                    c.append(v)
        gone = inside & (dealt.length > 1)
        rows = np.stack(part_cols, 1)[gone]
        for row, size in zip(labels[rows].tolist(), dealt.length[gone].tolist(), strict=True):
            for c, v in zip(cols, (lang, row[:size], True, 0, 0, 0, 0), strict=True):
                c.append(v)
        kinds = [pa.string(), pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    both = tables.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range"))
    return both.applyInArrow(run, "lang string, ids array<long>, inside boolean, a long, l long, r long, score long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language (null: ``und``) the ``top``
    phrases of 2 to 5 words by score, by count, by their bytes; all of them if ``top`` is None.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces into
    words at blanks and tabs. ``n`` is the number of words, ``a`` that of the phrase's occurrences
    within pieces (``least`` at least), ``l`` and ``r`` those of its parts by the cut with the
    lowest score, 1000 a n / (l r) rounded down. Phrases that lie in a longer one that is as
    frequent are left out. Null and empty texts hold no words; repeated rows count each; other
    columns are not used; an empty table gives no rows.
    """
    shards = save(_shards(docs, text_col, lang_col), "phrase-shards")
    side = ngrams.number_words(shards, ["lang"], 1, 0, "phrase-sides", least)
    if not shards.head(1):
        return docs.sparkSession.createDataFrame([], REPORT)
    known = docs.sparkSession.read.parquet(f"{side}/shard=-1")
    size = save(known.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    ranges = max(1, (size.agg(F.sum("n").alias("n")).first()["n"] or 0) // ngrams.RANGE_WORDS)
    known = known.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("labels").alias("label"))))

    def unite(table: pa.Table) -> pa.Table:
        automaton, _ = Automaton.union([Levels.from_bytes(x.as_py()) for x in table.column("blob")], least)
        return pa.table({"lang": table.column("lang").slice(0, 1), "range": table.column("range").slice(0, 1),
                         "blob": pa.array([automaton.levels().to_bytes()], pa.binary())})

    united = _transducers(shards, side, ranges).groupBy("lang", "range").applyInArrow(unite, "lang string, range long, blob binary")
    tables = save(save(united, "phrase-tables").join(size, "lang"), "phrase-counts")
    found = save(_scores(tables, _lookup(tables, ranges), ranges), "phrase-scores")
    kept = found.filter("not inside").join(found.filter("inside").select("lang", "ids").distinct(), ["lang", "ids"], "left_anti")
    each = kept.select("lang", "ids", "a", "l", "r", "score", F.posexplode("ids").alias("place", "label")).join(known, ["lang", "label"])
    spelled = each.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    spelled = save(spelled.select("lang", "a", "l", "r", "score", F.array_join(F.col("w.word"), " ").alias("phrase")), "phrase-spelled")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # first among shares of the phrases, then among the first of each
        shares = max(1, spelled.count() // RANK_ROWS)
        spelled = spelled.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        first = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        spelled = spelled.withColumn("k", first).filter(F.col("k") <= top)
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
