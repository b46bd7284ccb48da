"""Mixture-controlled packing: a deficit round-robin over source queues fills every window
with the target share of each source.

In each window a queue earns ``window x share`` tokens and sends whole tokens; the fraction
left is its deficit, carried to the next window. Summed from the first window on, what the
first s queues have sent is the whole part of their common share, so the state of the
round-robin before any window is known without running it. Each task cuts its own documents
from their place in the queue, and nothing passes from task to task but the lengths of the
queues' parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import save
from tessera.llm.tokens import encoder, token_table, vocabulary_path

SEQUENCE = 4096
END_ID = 2
#: Tokens of a queue that one task orders.
BUCKET_TOKENS = 2_000_000


@dataclass(frozen=True)
class Mixture:
    """The schedule. ``totals``: tokens of each queue. ``phases``: from token x of the output on,
    the share of each queue; a phase ends when a queue is empty and the others share its part."""

    length: int
    totals: tuple[int, ...]
    phases: tuple[tuple[Fraction, tuple[Fraction, ...]], ...]

    @staticmethod
    def make(length: int, totals: list[int], weights: list[Fraction] | None = None) -> Mixture:
        """``weights``: target proportions; None: those of the totals, so all queues end together."""
        w = [Fraction(t) for t in totals] if weights is None else list(weights)
        left, x, phases = [Fraction(t) for t in totals], Fraction(0), []
        while any(left):
            whole = sum(a for a, b in zip(w, left, strict=True) if b)
            share = tuple(a / whole if b else Fraction(0) for a, b in zip(w, left, strict=True))
            phases.append((x, share))
            span = min(b / s for b, s in zip(left, share, strict=True) if b)
            left = [b - span * s for b, s in zip(left, share, strict=True)]
            x += span
        return Mixture(length, tuple(totals), tuple(phases))

    @property
    def tokens(self) -> int:
        return sum(self.totals)

    @property
    def windows(self) -> int:
        return -(-self.tokens // self.length)


class Schedule:
    """Whole numbers of the mixture, as asked for by the tasks."""

    def __init__(self, m: Mixture):
        self.m = m
        self.begins = [p[0] for p in m.phases]
        self.shares, self.done = [], []
        before = [Fraction(0)] * (len(m.totals) + 1)
        for k, (x, share) in enumerate(m.phases):
            sums = [Fraction(0)]
            for s in share:
                sums.append(sums[-1] + s)
            if k:
                span = x - m.phases[k - 1][0]
                before = [b + span * c for b, c in zip(before, self.shares[-1], strict=True)]
            self.shares.append(sums)
            self.done.append(before)

    def sent_by_first(self, s: int, w: int) -> int:
        """Tokens that the first ``s`` queues have sent before window ``w``."""
        x = min(w * self.m.length, self.m.tokens)
        k = bisect_right(self.begins, x) - 1
        if k < 0:
            return 0
        share, done = self.shares[k][s], self.done[k][s]
        if not self.begins[k]:  # whole numbers only, the usual case of one phase
            return x * share.numerator // share.denominator
        return (done + (x - self.begins[k]) * share).__floor__()

    def sent(self, s: int, w: int) -> int:
        """Tokens that queue ``s`` has sent before window ``w``."""
        return self.sent_by_first(s + 1, w) - self.sent_by_first(s, w)

    def cut(self, s: int, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset there) of each piece of ``n`` tokens that begin at
        ``place`` of queue ``s``."""
        w = bisect_right(range(self.m.windows), place, key=lambda k: self.sent(s, k + 1))
        at, end = place, place + n
        while at < end:
            first, last = self.sent(s, w), self.sent(s, w + 1)
            stop = min(end, last)
            if stop > at:
                before = self.sent_by_first(s, w + 1) - self.sent_by_first(s, w)
                yield at - place, stop - at, w, before + at - first
                at = stop
            w += 1


def queues(totals: DataFrame, length: int, targets: dict[str, float] | None) -> tuple[list[str], Mixture | None]:
    """Names of the queues of their own and the mixture; the last queue holds all other sources.

    A source has its own queue if its share is two tokens a window or more (so there are at most
    ``length / 2``), or if it is a named target. The rest shares a queue, and where even that is
    too small the smallest own queue joins it.
    """
    whole = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not whole:
        return [], None
    if targets is not None:
        if min(targets.values(), default=1) * length < 2 * sum(targets.values()):
            raise ValueError("a target share must give two tokens a window at least")
        own = totals.filter(F.col("source").isin(list(targets)))
    else:
        own = totals.filter(F.col("n") * F.lit(length) >= F.lit(2 * whole))
    got = sorted(((r["n"], r["source"]) for r in own.filter("source is not null and n > 0").collect()), key=lambda r: (-r[0], r[1]))
    rest = whole - sum(n for n, _ in got)
    if targets is None and got and 0 < rest * length < 2 * whole:
        n, _ = got.pop()
        rest += n
    names, sizes = [s for _, s in got], [n for n, _ in got]
    if targets is None:
        return names, Mixture.make(length, [*sizes, rest])
    weights = [Fraction(targets[s]).limit_denominator(10**6) for s in names]
    left = Fraction(1) - sum(weights)
    return names, Mixture.make(length, [*sizes, rest], [*weights, max(left, Fraction(1, 100))])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None,
         targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, all full but the last.

    Per piece: the id, ``start`` (ids of its document before it), ``length``, ``ids_crc32``
    (unsigned, of the ids as little-endian unsigned 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id`` and ``offset`` (both from 0), ``padded_length`` (the sequence's length if
    that is a power of two, else ``length``) and ``ids`` (32-bit binary).

    Documents are cut wherever a window's share of their source ends. A null text is empty and
    packs as its end id; the string of a special token is that token, as the vocabulary file
    has it; a null source belongs to the shared queue; null and repeated ids are
    packed like others, dealt out by their tokens' hash too. Within a queue documents follow by a
    hash of their id and tokens, then by id.
    ``targets`` sets proportions by source (unnamed sources get what is left to 1); a source
    that runs dry leaves its share to the others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                        F.col(f"`{text_col}`").alias("text"))
    tokens = save(token_table(named, ["id", "source"], "text", vocabulary, end_id, special_as_text=False), "pack-tokens")
    own, mix = queues(tokens.groupBy("source").agg(F.sum("n").alias("n")), length, targets)
    # parts of a queue by its own tokens; rows that repeat an id, or have none, are told apart by their ids' hash
    many = [max(1, -(-t // BUCKET_TOKENS)) for t in (mix.totals if mix else ())] or [1]
    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(own)], F.lit(len(own)))
    parts = F.element_at(F.array(*map(F.lit, many)), F.col("queue") + 1)
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "ids", F.lit(5))
    dealt = tokens.select("id", "n", "ids", number.alias("queue")).withColumn("part", F.pmod(key, parts))
    sizes = dealt.groupBy("queue", "part").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("queue", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    base = save(base, "pack-bases")
    inside = Window.partitionBy("queue", "part").orderBy("id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # a row for each part: at most length / 2 queues, and parts of BUCKET_TOKENS tokens
    small = F.broadcast(base) if sum(many) <= 100_000 else base
    placed = placed.join(small, ["queue", "part"]).select("id", "queue", "n", "ids", (F.col("base") + F.col("inside")).alias("place"))
    return _cut(spark, placed, id_col, mix, vocabulary)


def _cut(spark, placed: DataFrame, id_col: str, mix: Mixture | None, vocabulary: str) -> DataFrame:
    held = spark.sparkContext.broadcast(mix)  # at most length / 2 queues

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        plan = Schedule(m) if m else None
        dtype = encoder(vocabulary, special_as_text=False).dtype
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
        for b in parts:
            if not b.num_rows:
                continue
            queue, n, place = (b.column(i).to_pylist() for i in (1, 2, 4))
            row, cols = [], [[] for _ in range(8)]
            for i, ids in enumerate(b.column(3)):
                wide = memoryview(np.frombuffer(ids.as_py(), dtype).astype("<u4").tobytes())
                for start, size, w, offset in plan.cut(queue[i], place[i], n[i]):
                    data = bytes(wide[4 * start:4 * (start + size)])
                    full = min(m.length, m.tokens - w * m.length)
                    row.append(i)
                    for col, v in zip(cols, (start, size, zlib.crc32(data), n[i], w, offset,
                                             full if full & (full - 1) == 0 else m.length, data), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:-1]],
                 pa.array(cols[-1], pa.binary())], names)

    kind = placed.schema["id"].dataType.simpleString()
    out = placed.select("id", "queue", "n", "ids", "place").mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
             "padded_length long, ids binary")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, put together from their pieces."""
    each = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return each.select("sequence_id", "n_tokens", joined.alias("ids"))
