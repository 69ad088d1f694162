"""Stored documents with their hot fields as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.operators.tables import shred_documents, shredded_name


def write_documents(docs: DataFrame, path: str, hot: list[str], cluster_by: tuple[str, str] | None = None, doc: str = "doc") -> None:
    """Write documents with plain columns for the fields ``hot``.

    cluster_by: (field, type) whose values shall lie together, so that the smallest and largest value of each
    file and row group let a filter on it leave most of them out.
    """
    rows = shred_documents(docs, hot, doc)
    if cluster_by is not None:
        order = F.col(shredded_name(doc, *cluster_by))
        rows = rows.repartitionByRange(order, F.xxhash64("_id")).sortWithinPartitions(order)
    rows.write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents and their plain columns, which ``document_filter`` uses and projections leave out."""
    return spark.read.parquet(path)
