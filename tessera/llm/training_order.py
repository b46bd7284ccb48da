"""Training-order materialisation: token sequences in a keyed random order, written as shards
of fixed stride that are read one after another and resumed anywhere."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import new_path, save
from tessera.llm.files import AtomicFile, filesystem, listing, size_of, spread
from tessera.llm.tokens import encoder, token_table, vocabulary_path

LENGTH = 1024
#: Closes a document and fills the last sequence of a partition; no text encodes to it.
END_ID = 49407
SHARD_SEQUENCES = 8192
ROUNDS = 6
KEY = 0x5DEECE66D


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts, keyed."""
    x = x + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Where each of 0 .. n - 1 goes under a keyed permutation of these numbers.

    A balanced Feistel network permutes the numbers of an even number of bits; results of n or
    more walk on along their cycle until they fall below n (under four steps on average).
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(key * (2 * r + 1) + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & low
        for k in keys if not inverse else reversed(keys):
            a, b = (b, a ^ (_mix(b, k) & low)) if not inverse else (b ^ (_mix(a, k) & low), a)
        return (a << shift) | b

    out = once(index.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(part, k, docs, n_tokens, ids): each partition's documents, closed by ``end_id``, one after
    another in sequences of ``length``; the partition's last one is filled with ``end_id``.
    ``docs`` are the ids of the documents with tokens in it."""
    vocabulary = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, part, k = encoder(vocabulary).dtype.itemsize, TaskContext.get().partitionId(), 0
        stride = length * width
        held, size, who = [], 0, []

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(ids_type)), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.binary())], ["part", "k", "docs", "n_tokens", "ids"])

        ids_type = pa.int64()
        for b in parts:
            ids_type, rows = b.schema.field(0).type, []
            for doc, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                view, at = memoryview(data.as_py()), 0
                while at < len(view):
                    take = min(stride - size, len(view) - at)
                    held.append(bytes(view[at:at + take]))
                    who.append(doc)
                    at, size = at + take, size + take
                    if size == stride:
                        rows.append((k, who, length, b"".join(held)))
                        held, size, who, k = [], 0, [], k + 1
            yield batch(rows)
        if size:
            fill = np.full((stride - size) // width, end_id, encoder(vocabulary).dtype).tobytes()
            yield batch([(k, who, size // width, b"".join(held) + fill)])

    tokens = token_table(docs, [id_col], text_col, vocabulary, end_id)
    return tokens.mapInArrow(run, f"part int, k long, docs array<{kind.simpleString()}>, n_tokens int, ids binary")


def assign_slots(sequences: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``sequences`` (written, with part and k) with ``slot``, its place in training order, and
    the number of sequences. Parts are numbered by the running sum of their sizes."""
    sizes = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the input
    base = save(sizes.select("part", "n", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base")), "sequence-bases")
    total = base.agg(F.sum("n")).first()[0] or 0
    small = F.broadcast(base.drop("n")) if base.count() <= 100_000 else base.drop("n")
    numbered = sequences.join(small, "part").withColumn("index", F.col("base") + F.col("k")).drop("base", "part", "k")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            slot = permute(b.column(b.num_columns - 1).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot)], [*b.schema.names, "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(run, f"{schema}, slot long"), total


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(slotted: DataFrame, total: int, folder: str, stride: int, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """Range partitions of slots write shard i with slots [i x per_shard, (i + 1) x per_shard), slot
    s at byte (s mod per_shard) x stride. A shard that is there in full size is not written
    again, so a broken job resumes. Returns (slot, shard, byte_offset, ...) per sequence."""
    shards = max(1, -(-total // per_shard))
    ranged = slotted.withColumn("shard", F.expr(f"slot div {per_shard}")).repartitionByRange(shards, "shard")
    ranged = ranged.sortWithinPartitions("slot")
    keep = [c for c in ranged.columns if c != "ids"]
    fields = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, expect = -1, None, 0
        for b in parts:
            slots = b.column("slot").to_pylist()
            for slot, data in zip(slots, b.column("ids"), strict=True):
                if slot // per_shard != shard:
                    if out:
                        out.commit()
                    shard, expect = slot // per_shard, slot // per_shard * per_shard
                    whole = min(per_shard, total - expect) * stride
                    out = None if size_of(folder, shard_name(shard)) == whole else AtomicFile(folder, shard_name(shard))
                if slot != expect:
                    raise ValueError(f"slot {expect} is missing before {slot}")
                expect += 1
                if out:
                    out.write(data.as_py())
            offset = pa.array([s % per_shard * stride for s in slots], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), offset], [*keep, "byte_offset"])
        if out:
            out.commit()

    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep)
    return save(ranged.mapInArrow(run, f"{schema}, byte_offset long"), "shard-rows")


def read_slots(folder: str, first: int, count: int, total: int, stride: int, per_shard: int = SHARD_SEQUENCES) -> Iterator[bytes]:
    """Sequences of slots first, first + 1, ... read in order, from any slot on."""
    at, end = first, min(total, first + count)
    while at < end:
        shard = at // per_shard
        stop = min(end, (shard + 1) * per_shard)
        f, base = filesystem(folder)
        with f.open_input_file(f"{base}/{shard_name(shard)}") as handle:
            for slot in range(at, stop):
                yield handle.read_at(stride, slot % per_shard * stride)
        at = stop


def read_shards(spark: SparkSession, folder: str, stride: int, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """(slot, ids_crc32) of every sequence as the shards hold it, one task a few shards."""
    files = listing(spark, folder, "shard-*.bin")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, name, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f, place = filesystem(path)
                first = int(name[6:14]) * per_shard
                with f.open_input_file(place) as handle:
                    crc = [zlib.crc32(handle.read(stride)) for _ in range(length // stride)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(crc))), pa.array(crc, pa.int64())],
                                                 ["slot", "ids_crc32"])

    return spread(files).mapInArrow(run, "slot long, ids_crc32 long")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                per_shard: int = SHARD_SEQUENCES, key: int = KEY, folder: str | None = None,
                vocabulary: str | None = None) -> DataFrame:
    """Cuts, orders and writes all documents; returns per sequence ``slot``, ``shard``,
    ``byte_offset``, ``index`` (before the permutation), ``n_tokens`` (without filling), ``docs``
    and ``ids_crc32`` of its bytes as read back from the shards.

    A null or empty text is its end id alone. Repeated rows and null ids are written like
    others; long texts span sequences. Other columns are not used; an empty table writes no
    shard and gives no rows.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    folder = folder or new_path(spark, "shards")
    stride = length * encoder(vocabulary).dtype.itemsize
    cut = save(cut_sequences(docs, id_col, text_col, length, END_ID, vocabulary), "sequences", 6)  # the largest table here
    slotted, total = assign_slots(cut, key)
    rows = write_shards(slotted, total, folder, stride, per_shard) if total else slotted.drop("ids").withColumn(
        "shard", F.col("slot")).withColumn("byte_offset", F.col("slot"))
    order = ["slot", "shard", "byte_offset", "index", "n_tokens", "docs"]
    if not total:
        return rows.select(*order, F.col("slot").alias("ids_crc32"))
    return rows.select(*order).join(read_shards(spark, folder, stride, per_shard), "slot")
