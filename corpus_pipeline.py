"""The corpus pipeline: quality, near duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as
the docs of the next one. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm import mixing, neardup, pieces, pii, quality
from orderweave.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the fences of their language and source go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id stays.

    Rows without doc_id stay. Rows that repeat a doc_id are one document.
    """
    gone = neardup.near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct()
    # Stored, so that Spark knows its size and moves the texts only if it must.
    return docs.join(stored(gone, "pipeline-duplicates"), "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, becomes marks; n_chars counts the new text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources get their target weights, in random order."""
    return mixing.mix(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text: ids, score, the next best segmentations, and whether decoding returns the text."""
    return pieces.encode(docs, pieces.Vocabulary.of(), "doc_id", "lang", "source")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]
#: Signatures, disguises and segmentations are beyond SQL; tests/llm/test_pipeline.py checks stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stored before the next; the last one is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
