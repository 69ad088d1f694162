"""Weakness tags, categories and severity roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.operators.joins import with_constant
from orderweave.sources.reports import cwe_ids, first_category_map


def severity_bucket(c: Column) -> Column:
    known = F.upper(F.coalesce(c, F.lit("UNKNOWN")))
    return F.when(known.isin(*fv.SEVERITIES), known).otherwise("UNKNOWN")


def tag_weaknesses(findings: DataFrame, categories: DataFrame, ranks: DataFrame,
                   text: str = "message") -> DataFrame:
    """One row per finding and weakness named in its text, with category and rank."""
    named = with_constant(findings, first_category_map(categories)).select(
        *findings.columns, "owasp_of", F.explode(F.array_distinct(cwe_ids(F.col(text)))).alias("cwe"))
    ranked = ranks.select("cwe", F.col("rank").alias("sans_rank"), F.col("name").alias("sans_name"))
    return named.withColumn("owasp_id", F.try_element_at("owasp_of", F.col("cwe"))).drop(
        "owasp_of").join(ranked, "cwe", "left")


def categorise_findings(findings: DataFrame, categories: DataFrame, ranks: DataFrame
                        ) -> tuple[DataFrame, DataFrame]:
    """Category rows ``(framework, category)`` per finding, and the uncategorised rest.

    A finding belongs to every listed known category, to every ranked weakness it
    carries, and once per weakness to a category the weakness implies and the finding
    does not list. Decided row by row: no shuffle of the findings.
    """
    known = findings
    for constant in (first_category_map(categories),
                     categories.agg(F.collect_set("owasp_id").alias("owasp_ids")),
                     ranks.agg(F.collect_set("cwe").alias("sans_ids"))):
        known = with_constant(known, constant)
    listed = F.coalesce("owasp_categories", F.array().cast("array<string>"))
    cwes = F.coalesce("cwes", F.array().cast("array<string>"))

    def entries(framework: str, ids: Column) -> Column:
        return F.transform(ids, lambda c: F.struct(F.lit(framework).alias("framework"),
                                                   c.alias("category")))

    owasp_ids, sans_ids = F.col("owasp_ids"), F.col("sans_ids")
    implied = F.array_compact(F.transform(
        cwes, lambda c: F.try_element_at(F.col("owasp_of"), c)))
    rows = F.concat(
        entries("owasp", F.filter(listed, lambda c: F.array_contains(owasp_ids, c))),
        entries("sans", F.filter(cwes, lambda c: F.array_contains(sans_ids, c))),
        entries("owasp", F.filter(implied, lambda c: ~F.array_contains(listed, c))))
    spread = known.withColumn("_entries", rows).select(
        *findings.columns, F.explode_outer("_entries").alias("_e"))
    return (spread.where(F.col("_e").isNotNull()).select(*findings.columns, "_e.*"),
            spread.where(F.col("_e").isNull()).select(*findings.columns))


def severity_counts(df: DataFrame, *by: str) -> DataFrame:
    bucket = severity_bucket(F.col("severity"))
    return df.groupBy(*by).agg(F.count("*").alias("finding_count"), *[
        F.count_if(bucket == s).alias(s.lower()) for s in fv.SEVERITIES])


def _zero_filled(df: DataFrame) -> DataFrame:
    return df.fillna(0, ["finding_count", *[s.lower() for s in fv.SEVERITIES]])


def severity_rollups(categorised: DataFrame, categories: DataFrame, ranks: DataFrame
                     ) -> tuple[DataFrame, DataFrame]:
    """Counts by severity for every category and every ranked weakness, zeros included."""
    def counts(framework: str, key: str) -> DataFrame:
        return severity_counts(categorised.where(F.col("framework") == framework),
                               "category").withColumnRenamed("category", key)

    by_category = _zero_filled(categories.select("owasp_id", "name").join(
        counts("owasp", "owasp_id"), "owasp_id", "left")).orderBy("owasp_id")
    by_rank = _zero_filled(ranks.select("cwe", "rank", "name").join(
        counts("sans", "cwe"), "cwe", "left")).orderBy("rank")
    return by_category, by_rank


def top_findings(findings: DataFrame, n: int, group: list[str], arrival: list[str]) -> DataFrame:
    """The first ``n`` findings of each group as they arrived.

    Spark keeps at most ``n`` rows per group and task before it shuffles them.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*arrival))
    return findings.withColumn("place", place).where(F.col("place") <= n)
