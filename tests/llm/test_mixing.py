"""Replication against the Poisson distribution and the target weights."""

import collections
import math

from pyspark.sql import functions as F

from orderweave.llm import mixing


def test_counts_follow_the_distribution(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(docs, {"a": 2.0, "b": 1.0}, epochs=1.5)
    seen = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    total = 1.5 * 60_000
    for source, share, size in (("a", 2 / 3, 20_000), ("b", 1 / 3, 40_000)):
        rate = share * total / size
        counts = collections.Counter(seen.get(i, 0) for i in range(60_000) if (i % 3 == 0) == (source == "a"))
        for n in range(6):
            want = size * math.exp(-rate) * rate ** n / math.factorial(n)
            assert abs(counts[n] - want) < 5 * math.sqrt(want) + 5


def test_weights_are_met_with_a_large_mean(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") < 40, "rare").otherwise("much").alias("source"))
    out = mixing.mix(docs, {"rare": 1.0, "much": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["rare"] - 1500) < 200 and abs(n["much"] - 1500) < 200
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_same_draw_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "copy", "shuffle_key").collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    rows = mixing.mix(docs).collect()
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)


def test_awkward_rows(spark, awkward):
    clash = awkward.withColumn("copy", F.lit("c")).withColumn("rate", F.lit(1)).withColumn("cdf", F.lit(2)).withColumn("size", F.lit(3))
    out = mixing.mix(clash, epochs=4.0)
    assert out.columns == [c for c in clash.columns if c != "copy"] + ["copy", "shuffle_key"]
    assert {r.source for r in out.collect()} <= {"s", None} and out.count() > 0
    assert mixing.mix(awkward, {"nobody": 1.0}).count() == 0
    assert mixing.mix(awkward, {"s": 0.0}).count() == 0
    assert mixing.mix(awkward.limit(0)).count() == 0
