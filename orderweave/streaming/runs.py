"""Running a stream over what is there now and reading its result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started inside; the session's own ones come back after."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str,
                   settings: dict[str, str] | None = None) -> DataFrame:
    """Process all available input into parquet files; each row exactly once.

    settings: session settings that the query shall start with, as its state store or the number
    of parts of its state; the session's own ones stay as they are.
    """
    spark = stream.sparkSession
    with session_settings(spark, settings or {}):
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", out).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_parquet(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream a parquet table that is a folder or one file.

    A pattern that matches just this path lets the source accept a single file too.
    """
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{path[:-1]}[{path[-1]}]"))


def tick(spark: SparkSession, folder: str, at: datetime | None = None) -> None:
    """Tell the streams that read the ticks of a folder that their sources are complete up to an instant.

    Without an instant the folder is only made.
    """
    rows = [] if at is None else [(at,)]
    spark.createDataFrame(rows, "timestamp timestamp").coalesce(1).write.mode("append").parquet(folder)


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("timestamp timestamp").parquet(folder)


def run_to_end(stream: DataFrame, ticks: str, last: datetime, out: str, checkpoint: str,
               settings: dict[str, str] | None = None) -> DataFrame:
    """As ``run_to_parquet``, and what is still open is closed as of ``last``.

    ticks: the folder whose ticks the stream reads. The tick is written when all input is in, so
    that it makes nothing late.
    """
    run_to_parquet(stream, out, checkpoint, settings)
    tick(stream.sparkSession, ticks, last)
    return run_to_parquet(stream, out, checkpoint, settings)
