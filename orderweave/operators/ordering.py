"""Rows of a group as one ordered list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(item: Column, *sort: Column) -> Column:
    """Aggregate: the items of a group in the order of the sort columns."""
    rows = F.array_sort(F.collect_list(F.struct(
        *[c.alias(f"s{i}") for i, c in enumerate(sort)], item.alias("v"))))
    return F.transform(rows, lambda r: r["v"])
