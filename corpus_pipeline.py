"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's docs.  All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from hotsets.llm.common import handoff, table
from hotsets.llm.decontam import remove_contamination
from hotsets.llm.linededup import drop_repeated_lines
from hotsets.llm.packing import pack_documents
from hotsets.llm.quality import drop_low_quality
from hotsets.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), at_least=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier line, has."""
    return drop_repeated_lines(docs, min_words=3, min_near_words=5, min_chars=20)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHashes of four-word shingles link within four bits."""
    return drop_near_duplicates(docs, shingle=4, max_bits=4)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents made of them go."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return pack_documents(docs, f.read(), size=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier's fit, the suffix automaton and the linear program are beyond SQL; tests/llm
#: hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else handoff(docs), sf_dir)
    return docs
