"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from orderweave.streaming.runs import session_settings


def local_session(cpus: int | str = 8, app: str = "orderweave") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a temporary
    folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="orderweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


_stored: list[str] = []


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` has made inside, once the results are written.

    A result must not be read after that. Outside of it the tables stay as long as the
    folder they lie in.
    """
    before = len(_stored)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _stored[before:]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        del _stored[before:]


def freed_shuffles(spark: SparkSession):
    """What is written inside drops its shuffle files as soon as it is written.

    Else they lie on the executors' disks until the driver happens to collect its garbage, those of
    all steps of a job together.
    """
    return session_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """A step of a long job as a compact table; nothing else of the step stays on disk."""
    with freed_shuffles(df.sparkSession):
        return stored(df, purpose, compression="zstd")


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write a table that several branches of a job read, and read it back.

    The branches then share one computation, survive lost executors, and Spark plans
    their joins with the table's real size. ``options`` go to the writer.
    """
    path = shared_dir(df.sparkSession, purpose)
    _stored.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
