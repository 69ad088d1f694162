"""Catalog sources: flat CSV or nested JSON to one typed, cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderweave.functions.text import blank_to_null, strip

REQUIRED = ("internal_code", "profile_name", "edi_pia_code")
OPTIONAL = ("alloy", "alloy_din", "temper", "profile_type", "standard_lengths_mm",
            "surface_finishes", "tolerance_standard", "category")
MEASURES = ("width_mm", "height_mm", "wall_thickness_mm", "weight_kg_per_m")

CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "internal_code", "profile_name", "alloy", "alloy_din", "temper", "width_mm", "height_mm",
    "wall_thickness_mm", "profile_type", "weight_kg_per_m", "standard_lengths_mm",
    "surface_finishes", "tolerance_standard", "category", "edi_pia_code")])
JSON_DDL = (
    "internal_code string, profile_name string, alloy string, alloy_din string, temper string,"
    "dimensions_mm struct<width:double,height:double,wall_thickness:double>,"
    "profile_type string, weight_kg_per_m double, standard_lengths_mm array<int>,"
    "surface_finishes array<string>, tolerance_standard string, category string,"
    "edi_pia_code string")


def flatten_catalog(nested: DataFrame) -> DataFrame:
    """Nested catalog records to the flat text columns of the CSV form."""
    size = {"width_mm": "width", "height_mm": "height", "wall_thickness_mm": "wall_thickness"}
    lists = ("standard_lengths_mm", "surface_finishes")

    def column(name: str):
        if name in size:
            return F.col(f"dimensions_mm.{size[name]}").cast("string")
        if name in lists:
            return F.array_join(F.col(name).cast("array<string>"), "|")
        return F.col(name).cast("string")

    return nested.select(*[column(f.name).alias(f.name) for f in CSV_SCHEMA])


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Trim all text, blank optional text to NULL, measures to doubles, status 'A'."""
    return raw.select(
        *[strip(F.col(c)).alias(c) for c in REQUIRED],
        *[blank_to_null(strip(F.col(c))).alias(c) for c in OPTIONAL],
        *[blank_to_null(strip(F.col(c))).try_cast("double").alias(c) for c in MEASURES],
        F.lit("A").alias("status"))


def load_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return clean_catalog(spark.read.schema(CSV_SCHEMA).csv(path, header=True))
    if fmt == "json":
        nested = spark.read.schema(JSON_DDL).json(path, multiLine=True)
        return clean_catalog(flatten_catalog(nested))
    raise ValueError(f"unknown catalog format: {fmt}")


def list_column(c: str):
    """Pipe-separated text as an array."""
    return F.split(F.col(c), r"\|")
