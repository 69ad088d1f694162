"""Lookup joins that stay balanced when keys are missing or hot.

No join here carries a broadcast hint. Spark broadcasts a side only when its
estimated or measured size is below ``spark.sql.autoBroadcastJoinThreshold``;
beyond that it shuffles, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SPREAD = 256


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def left_lookup(facts: DataFrame, dim: DataFrame, keys: list[str],
                spread_by: list[str], hashed: bool = False) -> DataFrame:
    """Left join to a table that is unique on ``keys``.

    hashed: the facts, many and wide, are not sorted; a partition of ``dim`` is held in memory.

    Rows without a key cannot match, yet a plain outer join would send all of
    them to one task. They get a spread value that no dimension row carries.
    """
    missing = any_of(F.col(k).isNull() for k in keys)
    spread = F.when(missing, F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREAD)) + 1)
    left = facts.withColumn("_spread", F.coalesce(spread, F.lit(0).cast("bigint")))
    # Always 0, but not a constant to the optimizer, which would drop a constant key
    # from the shuffle and bring all missing keys together again.
    right = dim.withColumn("_spread", F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint")))
    return left.join(right.hint("shuffle_hash") if hashed else right, [*keys, "_spread"], "left").drop("_spread")


def unique_rows(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key, the first in ``order_by``; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = F.struct(*order_by) if order_by else F.struct(*rest)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_constant(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table that has one row by construction, as subqueries."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed NULLs."""
    return df.select("*", *[F.lit(None).cast(t).alias(c)
                            for c, t in defaults.items() if c not in df.columns])
