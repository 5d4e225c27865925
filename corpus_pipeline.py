"""A corpus from raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import queries
from loomgraph.llm.shared import written

STAGES = [
    ("language_id", queries.stage_language_id),
    ("line_dedup", queries.stage_line_dedup),
    ("ngram_join", queries.stage_ngram_join),
    ("decontaminate", queries.stage_decontaminate),
    ("packing", queries.stage_packing),
]

#: Compression sizes, hashed seeds and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a row for each packed piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
