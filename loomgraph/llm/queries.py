"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, hard_negatives, html_extract, language_id, line_dedup, merkle_manifest, ngram_join, packing, quality, quality_rules, sharding, url_filter
from .shared import crc_fold, ship

#: Folds that the models don't learn from.
QUALITY_FOLDS, QUALITY_HELD_OUT = 5, 0
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2
QUALITY_THRESHOLD = 0.3
SHARDS = 24
#: Passages of more words than this go even if they are one or two lines.
PASSAGE_WORDS = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprints.compare_with_edits(docs, fingerprints.fit_lexicon(docs)).withColumnRenamed("key", "doc_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), QUALITY_FOLDS) == QUALITY_HELD_OUT
    model = quality.fit_quality(docs.where(~held_out), labels.where(~held_out))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def _languages(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.fit_languages(docs.where(crc_fold(F.col("doc_id"), LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    return language_id.identify(docs, _languages(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op9_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like op9_line_dedup, with repeated passages of one or two lines and over fifty words, which the SQL of that query leaves."""
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), over_words=PASSAGE_WORDS)
    return cleaned.select("doc_id", "text", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=SHARDS, grown=SHARDS + 1)
    return dealt.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows, label=label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle_manifest.manifest(docs, changed={"text": merkle_manifest.tampered_text()}).withColumnRenamed("key", "doc_id")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


# The pipeline's stages.


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter, null and empty texts among them, and those of a narrow margin.

    Labels are read where lang is not null; with no labelled row all documents go. Equal texts stay or go together, ties are
    narrow margins. Very long texts are judged whole. An empty table stays empty.
    """
    ship(spark)
    judged = language_id.identify(docs, _languages(docs), keep=tuple(docs.columns), flags_as="__")
    return judged.where("NOT __rejected").select(*docs.columns)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go, and with them documents that had nothing else.

    Null texts stay as they are, as do texts that were empty before; rows of one key and text are one document and keep their
    lines alike. Of equal lines the one of the least (key, text hash, position) stays. An empty table stays empty.
    """
    cleaned = line_dedup.dedup_lines(docs, removed="__removed", over_words=PASSAGE_WORDS)
    return cleaned.where("__removed = 0 OR text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; of its repeated rows one.

    Null and empty texts, and those of white space, are groups of their own and stay. Rows of one doc_id with several texts
    stay or go by key. Null keys stay if no row of their group has a key. An empty table stays empty. Very long texts are
    compared whole; other columns stay as they are.
    """
    ship(spark)
    groups = ngram_join.shingle_groups(docs)
    stay = groups.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("__key"))
    kept = docs.join(stay.distinct(), docs["doc_id"].eqNullSafe(F.col("__key")), "left_semi")
    keys = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    return kept if keys[0] == keys[1] else kept.dropDuplicates(["doc_id", "text"])


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a long enough stretch with a benchmark item go.

    Null and empty texts share nothing and stay, repeated rows stay or go together; an empty table or benchmark changes nothing.
    Very long texts are searched whole; other columns stay as they are.
    """
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed: null and empty texts as a single end token, repeated rows as documents of their own; an empty table gives no piece; very long texts are cut into pieces without loss; other columns go."""
    ship(spark)
    return packing.pack(docs).withColumnRenamed("key", "doc_id")


def queries() -> dict:
    found = (op1_html_extract, op2_packing, op3_fingerprints, op4_ngram_join, op5_quality, op6_url_filter, op7_language_id, op8_decontaminate, op9_line_dedup, op9_line_dedup_whole, op10_sharding, op11_hard_negatives, op12_merkle_manifest, op13_quality_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_merkle_manifest": merkle_manifest.ORACLE, "op13_quality_rules": quality_rules.ORACLE}
