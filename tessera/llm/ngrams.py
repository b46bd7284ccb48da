"""N-grams of a corpus as weighted acyclic automata.

Texts are gathered to shards of bounded size. A shard's words are dealt to ranges of their checksum,
which sum up and number them for all shards. Its sorted n-grams become one automaton for each range
of prefixes, which holds a state for every n-gram and the weight (count) of each. Automata of a
range are united level by level. Every n-gram belongs to the range that its shortest prefix with a
rare last word hashes to, so no range depends on how frequent a word is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_path
from tessera.llm.files import by_key, of_key

#: A shard is closed when it holds this many words; a longer text is a shard of its own.
SHARD_WORDS = 2_000_000
#: Words of the corpus for each range of prefixes.
RANGE_WORDS = 1_000_000
#: Distinct words of shards, summed over the shards, for each range of words.
RANGE_DISTINCT = 500_000
#: Words with more occurrences than this, and than one in ``MAX_HOT`` of all, do not end a prefix.
HOT_WORDS = 250_000
#: So there are fewer such words than this.
MAX_HOT = 1_000_000

WORD, WHITE, BREAK = 0, 1, 2


def byte_kinds(white: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(white)] = WHITE
    kinds[list(breaks)] = BREAK
    return kinds


def split_words(texts: list[bytes], kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts by their checksums, the number of each word in turn, its
    text, and its piece (words with no break between them)."""
    lower = b" ".join([t.lower() for t in texts]) + b" "
    data = np.frombuffer(lower, np.uint8)
    kind = kinds[data]
    inside = kind == WORD
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    at = np.flatnonzero(head)
    del head
    wide = np.int32 if len(data) < 1 << 31 else np.int64
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    text = np.searchsorted(begins, at, "right") - 1
    piece = np.cumsum(kind == BREAK, dtype=wide)[at] + text
    letters = data[inside]
    cuts = np.append(np.cumsum(inside, dtype=wide)[at] - 1, len(letters)).astype(np.int64)
    del kind, inside, data
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    order = np.argsort(checksums(coded.dictionary), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)).cast(pa.binary()), rank[coded.indices.to_numpy()], text, piece


def shard_numbers() -> Iterator[int]:
    """Numbers that no other task gives out."""
    base = TaskContext.get().partitionId() << 32
    n = 0
    while True:
        yield base + n
        n += 1


def one_list(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def checksums(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))


# --- bytes -------------------------------------------------------------------------------

def pack(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Arrays of unsigned numbers and some bytes, compressed; the bytes of equal place together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes, tail]))


def unpack(data: bytes) -> tuple[list[np.ndarray], memoryview]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, out, at = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), [], 8 + 16 * n
    for size, width in sizes:
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(size))
        at += size * width
    return out, memoryview(raw)[at:]


def words_of(lengths: np.ndarray, letters) -> pa.Array:
    cuts = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])


# --- numbers for words -------------------------------------------------------------------

def number_words(shards: DataFrame, keep: list[str], first: int, unknown: int, name: str, least: int | None = None) -> str:
    """Writes for every shard the labels and totals of its words, in their order, and returns the
    folder. Words are summed over all shards with equal ``keep`` columns.

    The label is even if a word is rare, odd if it is hot; labels under ``2 * first`` are free; words
    whose total is 0 have the label ``unknown``. Shard -1 holds a row for each range: ``n`` (the sum of
    the totals), ``v`` (words with a total), and the words of a total of ``least`` and their labels.
    """
    sums = shards.agg(F.sum("n_words").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    ranges = max(1, (sums["n"] or 0) // RANGE_DISTINCT)
    hot = max(HOT_WORDS, (sums["tokens"] or 0) // MAX_HOT)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                words = b.column(b.num_columns - 2)[i].values.cast(pa.large_binary())
                counts = b.column(b.num_columns - 1)[i].values.to_numpy()
                lengths = pc.binary_length(words).to_numpy().astype("<u4")
                cuts = np.searchsorted(checksums(words) * ranges >> 32, np.arange(ranges + 1))
                blobs = [(r, pack([lengths[a:z], counts[a:z].astype("<u8")], b"".join(words.slice(a, z - a).to_pylist())))
                         for r, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < z]
                same = [pa.array([b.column(c)[i].as_py()] * len(blobs), b.column(c).type) for c in range(b.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([r for r, _ in blobs], pa.int64()), pa.array([x for _, x in blobs], pa.binary())],
                                                 [*b.schema.names[:-2], "range", "data"])

    def number(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("data")]
        every = pa.concat_arrays([words_of(lengths, letters) for (lengths, _), letters in parts]).dictionary_encode()
        code = every.indices.to_numpy()
        totals = np.zeros(len(every.dictionary), np.int64)
        np.add.at(totals, code, np.concatenate([c for (_, c), _ in parts]).astype(np.int64))
        r = table.column("range")[0].as_py()
        label = ((np.arange(len(totals)) * ranges + r + first) * 2 + (totals > hot)).astype(np.int64)
        label[totals == 0] = unknown
        if label.max(initial=0) >= 1 << 32:
            raise ValueError("more words than 32-bit labels")
        cuts = np.cumsum([0, *(len(c) for (_, c), _ in parts)]).tolist()
        out = [pack([label[x].astype("<u4"), totals[x].astype("<u8")]) for x in (code[a:z] for a, z in zip(cuts, cuts[1:], strict=False))]
        listed = np.flatnonzero(totals >= least) if least else np.zeros(0, np.int64)
        n = len(out)
        last = [pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in keep]
        cols = {c: pa.concat_arrays([table.column(c).combine_chunks(), x]) for c, x in zip(keep, last, strict=True)}
        none = lambda x, kind: pa.array([None] * n + [x], kind)
        return pa.table({
            **cols, "range": pa.array([r] * (n + 1)), "shard": pa.concat_arrays([table.column("shard").combine_chunks(), pa.array([-1])]),
            "data": pa.array([*out, None], pa.binary()), "n": none(int(totals.sum()), pa.int64()), "v": none(int((totals > 0).sum()), pa.int64()),
            "words": none([w.decode() for w in every.dictionary.take(pa.array(listed)).to_pylist()], pa.list_(pa.string())),
            "labels": none(label[listed].tolist(), pa.list_(pa.int64()))})

    kinds = "".join(f"{c} {shards.schema[c].dataType.simpleString()}, " for c in keep)
    dealt = shards.select(*keep, "shard", "words", "counts").mapInArrow(deal, f"{kinds}shard long, range long, data binary")
    done = dealt.groupBy(*keep, "range").applyInArrow(
        number, f"{kinds}range long, shard long, data binary, n long, v long, words array<string>, labels array<long>")
    return by_shard(done, name)


def labels_of_shard(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and totals of a shard's words, in their order."""
    table = of_shard(folder, shard)
    if table is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [unpack(table.column("data")[int(i)].as_py())[0] for i in np.argsort(numpy_of(table, "range"))]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))


def by_shard(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder, each shard's rows apart for the task that reads the shard."""
    return by_key(df, "shard", new_path(df.sparkSession, name))


def of_shard(folder: str, shard: int) -> pa.Table | None:
    """The rows written for one shard; None if there are none."""
    return of_key(folder, "shard", shard)


def numpy_of(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().to_numpy(zero_copy_only=False)


# --- automata ----------------------------------------------------------------------------

@dataclass
class Levels:
    """An automaton by depth. State i of a level has ``children[i]`` states in the next one; they
    lie there in a row, in the order of their labels."""

    labels: list[np.ndarray]
    weights: list[np.ndarray]
    children: list[np.ndarray]

    def parents(self, depth: int) -> np.ndarray:
        if not depth:
            return np.zeros(len(self.labels[0]), np.int64)
        return np.repeat(np.arange(len(self.labels[depth - 1])), self.children[depth - 1])

    def to_bytes(self) -> bytes:
        return pack([x.astype("<u4") for x in self.labels + self.children] + [x.astype("<u8") for x in self.weights])

    @staticmethod
    def from_bytes(data: bytes) -> Levels:
        arrays, _ = unpack(data)
        depth = (len(arrays) + 1) // 3
        return Levels(arrays[:depth], [x.astype(np.int64) for x in arrays[2 * depth - 1:]], arrays[depth:2 * depth - 1])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _order(cols: list[np.ndarray], size: int, first: np.ndarray | None = None) -> np.ndarray:
    """The order of rows by their columns of numbers under ``size``, and before that by ``first``."""
    bits = max(1, int(size).bit_length())
    per, keys = 64 // bits, []
    for i in range(0, len(cols), per):
        key = np.zeros(len(cols[0]), np.uint64)
        for c in cols[i:i + per]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        keys.append(key)
    if first is None and len(keys) == 1:
        return np.argsort(keys[0])  # equal rows may come in any order
    return np.lexsort([*reversed(keys), *([] if first is None else [first])])


def _changes(cols: list[np.ndarray], first: np.ndarray | None = None) -> list[np.ndarray]:
    """For each depth, which rows begin a state: they share fewer labels with the row before."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    if first is not None:
        new[1:] = first[1:] != first[:-1]
    out = []
    for c in cols:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append(new)
    return out


@dataclass
class Windows:
    """Distinct windows of a sequence of numbers, in order. ``cols``: numbers by place, 0 beyond
    the window's end; ``weights``: the sum of its occurrences' weights; ``row``: the window that
    begins at each place of the sequence."""

    cols: list[np.ndarray]
    weights: np.ndarray
    row: np.ndarray


def windows(seq: np.ndarray, order: int, size: int, weights: np.ndarray | None = None, last: int | None = None) -> Windows:
    """Windows of up to ``order`` numbers from each place, ended before a 0 and after ``last``
    (but not by one in their first place)."""
    n = len(seq)
    cols, go = [seq], seq > 0
    for k in range(1, order):
        nxt = np.zeros(n, seq.dtype)
        nxt[:max(0, n - k)] = seq[k:]
        if last is not None and k > 1:
            go = go & (cols[-1] != last)
        nxt[~go] = 0
        go = go & (nxt > 0)
        cols.append(nxt)
    by = _order(cols, size)
    cols = [c[by] for c in cols]
    new = _changes(cols)[-1]
    at = np.flatnonzero(new)
    row = np.empty(n, np.int64)
    row[by] = np.cumsum(new) - 1
    total = np.add.reduceat(np.ones(n, np.int64) if weights is None else weights[by].astype(np.int64), at) if n else np.zeros(0, np.int64)
    return Windows([c[at] for c in cols], total, row)


class Dealt:
    """Rows of numbers dealt to ranges by their prefixes, as one automaton for each range.

    ``labels`` gives the label of each number (0: none) in ascending order. A row belongs to the
    range of its shortest prefix that ends with a rare word, or of the whole row, or of its first
    ``longest`` labels. It adds its weight to its states from that depth on, or to the last one
    where ``whole`` holds. ``ordered``: the rows are in order.
    """

    def __init__(self, cols: list[np.ndarray], weights: np.ndarray, labels: np.ndarray, ranges: int,
                 whole: np.ndarray | None = None, longest: int | None = None, ordered: bool = False):
        n, order = len(cols[0]), len(cols)
        length = sum((c > 0).astype(np.int64) for c in cols)
        depth = np.full(n, 1, np.int64)
        hot = np.ones(n, bool)
        for k, c in enumerate(cols[:-1]):
            hot &= (labels[c] & 1).astype(bool)
            depth += hot & (length > k + 1) & (True if longest is None else k + 1 < longest)
        self.prefix, self.length = depth, length
        h, chosen = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k, c in enumerate(cols):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + labels[c].astype(np.uint64) + np.uint64(1))
            chosen = np.where(depth == k + 1, h, chosen)
        dealt = ((chosen >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        low = depth if whole is None else np.where(whole, length, depth)
        high = np.full(n, order) if whole is None else np.where(whole, length, order)
        by = np.argsort(dealt.astype(np.uint16) if ranges < 1 << 16 else dealt, kind="stable") if ordered else _order(cols, len(labels), dealt)
        self.by, self.range = by, dealt[by]
        cols, weights, low, high = [c[by] for c in cols], weights[by], low[by], high[by]
        self.new = [s & (c > 0) for s, c in zip(_changes(cols, self.range), cols, strict=True)]
        self.at = [np.flatnonzero(s) for s in self.new]
        self.labels = [labels[c[a]] for c, a in zip(cols, self.at, strict=True)]
        self.weights, self.children = [], []
        for k, (a, c) in enumerate(zip(self.at, cols, strict=True)):
            own = weights * ((c > 0) & (low <= k + 1) & (k + 1 <= high))
            self.weights.append(np.add.reduceat(own, a) if len(a) else np.zeros(0, np.int64))
            if k + 1 < order:
                self.children.append(np.add.reduceat(self.new[k + 1].astype(np.int64), a) if len(a) else np.zeros(0, np.int64))

    def state(self, depth: int) -> np.ndarray:
        """For each row given, its state at a depth (from 0), counted over all ranges; rows that
        are shorter get any."""
        out = np.empty(len(self.by), np.int64)
        out[self.by] = np.maximum(0, np.cumsum(self.new[depth]) - 1)
        return out

    def blobs(self) -> Iterator[tuple[int, Levels]]:
        if not len(self.range):
            return
        first = np.flatnonzero(np.diff(self.range, prepend=-1))
        ends = np.append(first[1:], len(self.range))
        lo, hi = ([np.searchsorted(a, x) for a in self.at] for x in (first, ends))
        for i, r in enumerate(self.range[first].tolist()):
            part = [slice(a[i], b[i]) for a, b in zip(lo, hi, strict=True)]
            yield r, Levels([x[s] for x, s in zip(self.labels, part, strict=True)],
                            [x[s] for x, s in zip(self.weights, part, strict=True)],
                            [x[s] for x, s in zip(self.children, part, strict=False)])


class Automaton:
    """The union of automata: ``keys`` of a level are its arcs, the state before shifted by 32 bits
    and the label, in order; ``weights`` are the sums."""

    def __init__(self, keys: list[np.ndarray], weights: list[np.ndarray]):
        self.keys, self.weights = keys, weights

    @staticmethod
    def union(parts: list[Levels], least: int = 0) -> tuple[Automaton, list[list[np.ndarray]]]:
        """The union with weights summed, and for each part the states of the union by depth. With
        ``least``, states of a positive weight under it go (their state is -1), with all below."""
        keys, weights, maps = [], [], [[] for _ in parts]
        for depth in range(max((len(p.labels) for p in parts), default=0)):
            arcs = [p.labels[depth].astype(np.uint64) for p in parts]
            before = [m[-1][p.parents(depth)] if depth else np.zeros(len(a), np.int64) for p, m, a in zip(parts, maps, arcs, strict=True)]
            state, every = np.concatenate(before), np.concatenate([p.weights[depth] for p in parts])
            live = state >= 0
            arc = state[live].astype(np.uint64) << np.uint64(32) | np.concatenate(arcs)[live]
            key, where = np.unique(arc, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, every[live])
            kept = (total == 0) | (total >= least)
            number = np.where(kept, np.cumsum(kept) - 1, -1)
            states = np.full(len(state), -1, np.int64)
            states[live] = number[where]
            for m, x in zip(maps, np.split(states, np.cumsum([len(a) for a in arcs])[:-1]), strict=True):
                m.append(x)
            keys.append(key[kept])
            weights.append(total[kept])
        return Automaton(keys, weights), maps

    def levels(self) -> Levels:
        children = [np.bincount((k >> np.uint64(32)).astype(np.int64), minlength=len(u)) for u, k in zip(self.keys, self.keys[1:], strict=False)]
        return Levels([(k & np.uint64(0xFFFFFFFF)).astype(np.uint32) for k in self.keys], self.weights, children)

    @staticmethod
    def of(levels: Levels) -> Automaton:
        keys = [levels.parents(d).astype(np.uint64) << np.uint64(32) | x.astype(np.uint64) for d, x in enumerate(levels.labels)]
        return Automaton(keys, levels.weights)

    def compose(self, asked: Levels) -> list[np.ndarray]:
        """Weights of the states of another automaton, 0 for those that this one lacks."""
        out, state = [], None
        for depth, labels in enumerate(asked.labels):
            before = state[asked.parents(depth)] if depth else np.zeros(len(labels), np.int64)
            keys = self.keys[depth] if depth < len(self.keys) else np.zeros(0, np.uint64)
            arc = np.maximum(before, 0).astype(np.uint64) << np.uint64(32) | labels.astype(np.uint64)
            at = np.searchsorted(keys, arc)
            hit = (before >= 0) & (at < len(keys))
            hit[hit] = keys[at[hit]] == arc[hit]
            state = np.where(hit, at, -1)
            weight = np.zeros(len(labels), np.int64)
            weight[hit] = self.weights[depth][at[hit]]
            out.append(weight)
        return out

    def paths(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, labels of the path by place, weight) of all states of positive weight, by depth."""
        out, path = [], None
        for depth, key in enumerate(self.keys):
            own = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            path = own[:, None] if path is None else np.c_[path[(key >> np.uint64(32)).astype(np.int64)], own]
            some = self.weights[depth] > 0
            out.append((depth + 1, path[some], self.weights[depth][some]))
        return out
