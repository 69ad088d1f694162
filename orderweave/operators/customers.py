"""Customer rules, secrets and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.text import strip


def customer_quality(customers: DataFrame, strategies=fv.STRATEGIES,
                     keyed=fv.KEYED_STRATEGIES) -> tuple[DataFrame, DataFrame]:
    """Valid customers, and the others with the ordered list of broken rules."""
    code = F.coalesce("code", F.lit(""))
    key = F.coalesce("api_key", F.lit(""))
    strategy = F.coalesce("extraction_strategy", F.lit(strategies[0]))
    broken = F.array_compact(F.array(
        F.when(~code.rlike(fv.CUSTOMER_CODE) | ~F.length(code).between(2, 40), "bad_code"),
        F.when(F.coalesce("display_name", F.lit("")) == "", "name_missing"),
        F.when(~strategy.isin(*strategies), "unknown_strategy"),
        F.when(strategy.isin(*keyed) & (key == ""), "key_missing"),
        F.when(F.lower(strip(key)).startswith("http"), "key_is_url")))
    judged = customers.withColumn("violations", broken)
    return (judged.where(F.size("violations") == 0).drop("violations"),
            judged.where(F.size("violations") > 0))


def mask_secrets(customers: DataFrame) -> DataFrame:
    has_key = F.coalesce("api_key", F.lit("")) != ""
    return customers.withColumn("has_api_key", has_key).drop("api_key")


def active_customers(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("active")).orderBy("display_name")
