"""Document text from page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.text import strip


def _joined(column: str):
    pages = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce(
        column, F.lit("")).alias("text"))))
    return F.array_join(F.transform(pages, lambda p: p["text"]), "\n")


def documents_from_pages(pages: DataFrame, customers: DataFrame) -> DataFrame:
    """One text per document from ``(doc_id, customer, page_no, text[, markdown])``.

    Pages join in page order; the marked-up rendering stands in for customers read
    by a model, when it is not blank. A document is one text value, so its pages
    meet in one group by nature.
    """
    marked = "markdown" in pages.columns
    text = pages.groupBy("doc_id", "customer").agg(
        _joined("text").alias("plain"),
        (_joined("markdown") if marked else F.lit(None).cast("string")).alias("marked"))
    strategy = customers.select(F.col("code").alias("customer"), "extraction_strategy")
    by_model = F.col("extraction_strategy").isin(*fv.MODEL_STRATEGIES)
    use_marked = by_model & (strip(F.coalesce("marked", F.lit(""))) != "")
    return text.join(strategy, "customer", "left").select(
        "doc_id", "customer", "extraction_strategy",
        F.when(use_marked, F.col("marked")).otherwise(F.col("plain")).alias("text"))


def model_input(docs: DataFrame, template: str, max_chars: int | None = None) -> DataFrame:
    """Adds ``model_text``: the document inside a template with ``{document}``.

    The whole text is used unless the caller's model sets a limit.
    """
    before, after = template.split("{document}")
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    return docs.withColumn("model_text", F.concat(F.lit(before), text, F.lit(after)))
