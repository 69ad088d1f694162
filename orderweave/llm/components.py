"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.session import stored


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """node, component (its smallest node) for each node of ``links`` (a, b: long).

    Contraction: each node joins the first of its closed neighbourhood in an order that
    changes by round (the ids first, then hashes), links are drawn between what the nodes
    have joined, and so on until none is left. In hash order a round takes away a constant
    share of the nodes of any graph, also of a long chain, so the rounds grow with the
    logarithm of the links. All sums are formed before the shuffle; a node with very many
    links is one row of the right-hand side of its join, whose left side Spark can split.
    """
    left = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                  f"{purpose}-links")
    nodes = left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    round_ = 0
    while not left.isEmpty():
        rank = F.lit(0).cast("long") if round_ == 0 else F.xxhash64(F.lit(round_), F.col("y"))
        both = left.select(F.col("a").alias("x"), F.col("b").alias("y")).union(left.select(F.col("b"), F.col("a")))
        near = both.union(left.select("a", "a")).union(left.select("b", "b"))
        joined = stored(near.groupBy("x").agg(F.min(F.struct(rank.alias("rank"), F.col("y"))).alias("m")).select(
            "x", F.col("m.y").alias("to")), f"{purpose}-{round_}-joined")
        at = lambda col: joined.select(F.col("x").alias(col), F.col("to").alias(f"{col}_to"))
        left = stored(left.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{purpose}-{round_}-links")
        nodes = stored(nodes.join(joined.withColumnRenamed("x", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), f"{purpose}-{round_}-nodes")
        round_ += 1
    smallest = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(smallest, "root").select("node", "component")
