"""Corpus pipeline: quality filter, language filter, near-duplicate removal, benchmark
decontamination, packing. Each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, packing, quality, simhash
from tessera.llm.common import crc_mod, save
from tessera.sources.tables import load


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier scores under one half (learned on the fold of
    op7). Null and empty texts have the share of good labels as their score; null and repeated ids
    are scored by their text alone; all columns stay; an empty table gives an empty one."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) or without a clear language
    (learned on the fold of op2). Null and repeated ids are judged by their text alone; all columns
    stay; an empty table gives an empty one."""
    return langid.keep_known(docs, crc_mod(F.col("doc_id"), 4) != 2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group (3-word shingles, 2 bits): that with the smallest id,
    null ids last, repeated ids told apart by their rows. Null and empty texts are one group; all
    columns stay; an empty table gives an empty one. ``docs`` is a table as read from Parquet files,
    as every stage gets it; its rows are known by file and place, and no text is shuffled."""
    return simhash.drop_near_duplicates(docs, length=3, bound=2, stored=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Null and empty texts stay; null and repeated ids
    are judged by their text alone; all columns stay; an empty table or benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, sources mixed in proportion. A null text packs as its end id, a null
    source belongs to the shared queue, null and repeated ids pack like others; other columns are
    not used; an empty table gives no rows."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The learned stages and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
