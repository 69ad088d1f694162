"""Stored tables whose changes rewrite only the parts they touch.

A keyed table is a folder of parquet files, partitioned by a part number that follows from the key:
ranges of a whole-number key, so that filters on it leave parts out, or a hash of any key. Changes find
the parts they touch, read those alone, and overwrite them; the files of all others stay
as they are. New rows of a part are written in full before the old ones go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.operators import tables
from orderweave.session import stored
from orderweave.sources.sinks import Files

PART = "part_no"
#: The most ranges a table is dealt over when it is written. Every change lists, plans and moves files by
#: part, so their number must not grow with the rows.
MOST_PARTS = 512


@dataclass(frozen=True)
class KeyedTable:
    """A stored table with the columns of ``schema``.

    width: how many keys one part spans, for a single key of a whole-number type; without it keys are dealt
    over ``parts`` by a hash. Rows without a key are one part (ranges) or dealt like others (hash).
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    width: int | None = None
    parts: int = 64

    def part(self) -> Column:
        if self.width is None:
            return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("bigint")
        return F.floor(F.col(self.keys[0]) / F.lit(self.width)).cast("bigint")

    def read(self, spark: SparkSession, only: Column | None = None) -> DataFrame:
        """The rows; ``only``: a predicate on the part number, which leaves files out."""
        schema = T.StructType([*self.schema, T.StructField(PART, T.LongType())])
        found = spark.read.schema(schema).parquet(self.path)
        return (found if only is None else found.where(only)).select(self.schema.names)

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.select(*self.schema.names, self.part().alias(PART)).repartition(PART)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def key_range(self, low: int | None, high: int | None) -> Column | None:
        """The parts that can hold keys from low to high, both included; None: no part can be left out."""
        if self.width is None or (low is None and high is None):
            return None
        bounds = [F.col(PART) >= low // self.width] if low is not None else []
        bounds += [F.col(PART) <= high // self.width] if high is not None else []
        return tables.all_of(bounds)

    def _rewrite(self, touched: DataFrame, change: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[int, DataFrame]:
        """Apply a change to the parts named in a table; the number of parts, and what the change reports.

        The list of parts is bounded by the table's layout, not by its rows.
        """
        spark = touched.sparkSession
        numbers = [r[0] for r in touched.select(PART).distinct().collect()]
        known = [n for n in numbers if n is not None]
        only = F.col(PART).isin(known) if known else F.lit(False)
        if len(known) < len(numbers):
            only = only | F.col(PART).isNull()
        rows, report = change(self.read(spark, only))
        # Stored first: they are read from the files that they replace.
        rows, report = stored(rows, "keyed-rows"), stored(report, "keyed-report")
        self._write(rows, "overwrite")
        # Overwriting leaves parts alone that have no row any more.
        left = {r[0] for r in rows.select(self.part().alias(PART)).distinct().collect()}
        files = Files(spark)
        for number in set(numbers) - left:
            name = "__HIVE_DEFAULT_PARTITION__" if number is None else number
            files.delete(f"{self.path}/{PART}={name}")
        return len(numbers), report


def _widened(df: DataFrame, key: str, width: int) -> int:
    """The width, times a whole number that leaves ``MOST_PARTS`` ranges at most from the least key to the greatest."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return width
    # One less, since an end may lie inside a range.
    return width * max(1, -(-(high // width - low // width + 1) // (MOST_PARTS - 1)))


def write_keyed(df: DataFrame, path: str, keys: list[str], width: int | None = None, parts: int = 64) -> KeyedTable:
    """Write a new keyed table. width: the least span of a part; a wide range of keys gets wider parts."""
    if width is not None and (len(keys) != 1 or not isinstance(df.schema[keys[0]].dataType, T.IntegralType)):
        raise ValueError("ranges need one key of a whole-number type")
    if width is not None:
        width = _widened(df, keys[0], width)
    table = KeyedTable(path, df.schema, tuple(keys), width, parts)
    table._write(df, "append")
    return table


def merge_stored(table: KeyedTable, source: DataFrame, mode: str = "ignore", prefer: Column | None = None) -> tuple[int, DataFrame]:
    """``merge_rows`` into a stored table: how many parts were rewritten, and the rows set aside."""
    source = stored(source.select(table.schema.names), "keyed-source")
    keys = list(table.keys)
    return table._rewrite(source.select(table.part().alias(PART)),
                          lambda rows: tables.merge_rows(rows, source, keys, mode, prefer))


def _hits(table: KeyedTable, spark: SparkSession, filters: dict[str, str], low: int | None, high: int | None) -> DataFrame:
    rows = table.read(spark, table.key_range(low, high))
    return rows.where(tables.filter_column(rows, filters)).select(table.part().alias(PART))


def _key_bounds(table: KeyedTable, filters: dict[str, str]) -> tuple[int | None, int | None]:
    """The lowest and highest key that the filters let through, as far as they name the key."""
    op, _, value = filters.get(table.keys[0], "").partition(":")
    if table.width is None or op not in ("eq", "lt", "lte", "gt", "gte"):
        return None, None
    number = int(value)
    return (number if op in ("eq", "gt", "gte") else None), (number if op in ("eq", "lt", "lte") else None)


def update_stored(table: KeyedTable, spark: SparkSession, filters: dict[str, str], changes: dict) -> tuple[int, DataFrame]:
    """``update_where`` on a stored table: how many parts were rewritten, and the changed rows."""
    if set(changes) & set(table.keys):
        raise ValueError("a change of the key would move rows to other parts")
    return table._rewrite(_hits(table, spark, filters, *_key_bounds(table, filters)),
                          lambda rows: tables.update_where(rows, filters, changes))


def delete_stored(table: KeyedTable, spark: SparkSession, filters: dict[str, str]) -> tuple[int, DataFrame]:
    """``delete_where`` on a stored table: how many parts were rewritten, and the deleted rows."""
    return table._rewrite(_hits(table, spark, filters, *_key_bounds(table, filters)),
                          lambda rows: tables.delete_where(rows, filters))
