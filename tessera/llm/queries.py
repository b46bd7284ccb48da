"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, ann, decontaminate, extract, langid, lm, packing, phrases, quality, simhash, token_counts, training_order, warc
from tessera.llm.common import crc_mod
from tessera.sources.tables import load


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = langid.learn(docs, ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"), length=3, bound=2)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents")).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(load(spark, sf_dir, "documents"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = quality.learn(docs, load(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    out = quality.score(docs, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.main_text(load(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(load(spark, sf_dir, "pages")).drop("complete")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(load(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(load(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod(F.col("doc_id"), 10)
    return lm.scores(load(spark, sf_dir, "documents"), fold != 0).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


QUERIES = {
    "op1_multiprobe_search": op1_multiprobe_search,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_compression_quality": op7_compression_quality,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc_segments": op9_warc_segments,
    "op10_training_order": op10_training_order,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_lm_scoring": op13_lm_scoring,
}

_WORDS = ("list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")

ORACLE_SQL = {
    "op5_decontamination": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS.format('text')} as w from documents),
        b as (select item_id, {_WORDS.format('text')} as w from benchmark),
        bw as (select item_id, least(len(w), 10) as n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i, w
               from b where len(w) > 0),
        win as (select distinct cast(item_id as varchar) as item, n, list_slice(w, i, i + n - 1) as win from bw),
        ln as (select distinct n from win),
        dw as (select r, n, unnest(generate_series(1, len(w) - n + 1)) as i, w from d, ln where len(w) >= n),
        hit as (select dw.r, dw.i, dw.n, win.item from dw join win
                on win.n = dw.n and win.win = list_slice(dw.w, dw.i, dw.i + dw.n - 1)),
        words as (select r, count(distinct p) as n_hit
                  from (select r, unnest(generate_series(i, i + n - 1)) as p from hit) group by r),
        items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s
                  from (select distinct r, item from hit where item is not null) group by r)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (r) left join items using (r)""",
}
