"""Token counts of documents in flat token files without an index.

A file is token ids one after another, each document closed by an end-of-document id. The
files are cut in blocks of fixed size, whatever documents begin or end there; each block is
searched for the end id with one vector comparison, and documents across block boundaries are
stitched by a prefix scan over the blocks' numbers of ends and last ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import new_path, save
from tessera.llm.files import AtomicFile, filesystem, listing, spread
from tessera.llm.tokens import encoder, token_table, vocabulary_path

#: The vocabulary's own end-of-text id, which no text encodes to.
END_ID = 49407
BLOCK_BYTES = 8 << 20
#: Blocks whose running sums one task makes at the lower level of the scan.
SUPER = 1024


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One flat file per input partition. Returns who lies where: (id, name, ordinal)."""
    vocabulary = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, ordinal = f"tokens-{TaskContext.get().partitionId():06d}.bin", None, 0
        for b in parts:
            out = out or AtomicFile(folder, name)
            for ids in b.column(2):
                out.write(ids.as_py())
            places = pa.array(np.arange(ordinal, ordinal + b.num_rows))
            ordinal += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows, pa.string()), places],
                                             ["id", "name", "ordinal"])
        if out:
            out.commit()

    return save(token_table(docs, [id_col], text_col, vocabulary, end_id).mapInArrow(
        run, f"id {kind}, name string, ordinal long"), "token-files")


def count_tokens(spark: SparkSession, folder: str, itemsize: int, end_id: int = END_ID, pattern: str = "*.bin",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(name, ordinal, start, n_tokens, ended): the documents of every file in order. ``start``
    is the first token's place in the file, ``n_tokens`` leaves out the end id, and ``ended`` is
    false for ids after the last end. Files need no sizes in whole blocks; an empty file has no
    documents; two ends in a row hold an empty document."""
    dtype, step = np.dtype(f"<u{itemsize}"), max(1, block_bytes // itemsize)
    files = listing(spark, folder, pattern).withColumn("tokens", F.floor(F.col("length") / itemsize))
    blocks = files.filter("tokens > 0").select("path", "name", "tokens", F.explode(F.expr(
        f"sequence(0L, (tokens - 1) div {step})")).alias("block"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, name, tokens, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f, place = filesystem(path)
                first = block * step
                with f.open_input_file(place) as handle:
                    ids = np.frombuffer(handle.read_at(min(step, tokens - first) * itemsize, first * itemsize), dtype)
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([tokens]), pa.array([block]), pa.array([ends], pa.list_(pa.int64()))],
                    ["name", "tokens", "block", "ends"])

    found = save(spread(blocks).mapInArrow(
        scan, "name string, tokens long, block long, ends array<long>"), "token-ends")
    each = found.select("name", "block", F.expr(f"block div {SUPER}").alias("super"), F.size("ends").alias("n"),
                        F.try_element_at("ends", F.lit(-1)).alias("last"))
    upper = each.groupBy("name", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("name").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("name", "super", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"),
                         F.coalesce(F.max("last").over(over), F.lit(-1)).alias("last0"))
    lower = Window.partitionBy("name", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("n1", F.coalesce(F.sum("n").over(lower), F.lit(0))).withColumn("last1", F.max("last").over(lower))
    carry = each.join(upper, ["name", "super"]).select(
        "name", "block", (F.col("n0") + F.col("n1")).alias("ordinal0"), F.coalesce("last1", "last0").alias("before"))
    rows = found.join(carry, ["name", "block"])
    ended = rows.select("name", F.explode(F.expr(
        "transform(ends, (x, i) -> struct(ordinal0 + i as ordinal, if(i = 0, before, get(ends, i - 1)) + 1 as start, x as stop))"
    )).alias("d")).select("name", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
                          F.lit(True).alias("ended"))
    tail = found.groupBy("name").agg(F.max("tokens").alias("tokens"), F.sum(F.size("ends")).alias("ordinal"),
                                     (F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)) + 1).alias("start"))
    tail = tail.filter("tokens > start").select("name", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"),
                                                F.lit(False).alias("ended"))
    return ended.unionByName(tail)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          vocabulary: str | None = None) -> DataFrame:
    """Writes the documents as flat token files and counts them from these alone: per row of
    ``docs`` the id, ``n_tokens`` (without the end id), ``file``, ``ordinal`` and ``start`` there.

    Null and empty texts count 0; repeated rows and null ids are counted each; texts of any
    length may span blocks. Other columns are not used; an empty table gives no rows.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    folder = new_path(spark, "token-data")
    who = write_token_files(docs, folder, id_col, text_col, END_ID, vocabulary)
    if not who.head(1):
        return who.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.col("name").alias("file"),
                          "ordinal", F.lit(0).cast("long").alias("start"))
    counts = count_tokens(spark, folder, encoder(vocabulary).dtype.itemsize)
    return counts.join(who, ["name", "ordinal"]).select(
        F.col("id").alias(id_col), "n_tokens", F.col("name").alias("file"), "ordinal", "start")
