"""Exact top-k search by MaxScore over shards of postings.

Each component of a vector makes two terms, one for its positive and one for its negative values;
a term's postings are the rows with such a value. A query's terms of its own sign add to a score, the
others take away. Per shard, a term's bound is the query's value times the largest in the
postings. Terms are ordered by bound: the non-essential ones are as many of the smallest as
cannot reach the k-th best score so far together. A row that stands in no essential posting
cannot enter the top k. The essential postings are traversed and summed; of the rows found, those
that can still compete are probed for the other terms, a few at a time, the largest bounds
first, and dropped as soon as their score and the bounds that are left fall behind. The k best
of each shard are merged.

The k-th best score starts from the heads of the query's strongest postings, which are kept in
order of value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm.groups import groups

#: Rows of a shard and queries of a block, on average. A task holds one of each at a time.
SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
#: Rows at the head of each of the strongest postings that set the first k-th best score; terms probed at once.
HEADS, STRONGEST, PROBE = 8, 6, 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Shard:
    """Postings and rows of a shard; ids are distinct and ascending."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.terms = []  # (rows in order of falling value, values), for the positive and the negative side
        self.bounds = np.zeros((2, rows.shape[1]))
        for side, values in enumerate((rows, -rows)):
            for d in range(rows.shape[1]):
                at = np.flatnonzero(values[:, d] > 0)
                at = at[np.argsort(-values[at, d], kind="stable")]
                self.terms.append((at, values[at, d]))
                self.bounds[side, d] = values[at[0], d] if len(at) else 0

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best but the row of id ``own``; ties to the smaller id."""
        side = (query < 0).astype(int)
        weight = np.abs(query)
        bound = weight * self.bounds[side, np.arange(len(query))]
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        width = len(query)
        posting = lambda d: self.terms[side[d] * width + d]
        heads = [posting(d)[0][:HEADS] for d in order[::-1][:STRONGEST]]
        seeds = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        seeds = seeds[self.ids[seeds] != own]
        scores = self.rows[seeds] @ query
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
        # With the smallest bounds alone no row gets to ``least``; a score may also be negative, or 0.
        first = int(np.searchsorted(below, least, side="left")) if least > 0 else 0
        if least > 0:
            essential, rest = order[first:], order[:first]
            found = np.zeros(len(self.ids))
            for d in essential:
                at, values = posting(d)
                found[at] += values * weight[d]
            left = below[first - 1] if first else 0.0
            rows = np.flatnonzero((found > 0) & (found + left >= least))
            # What takes away within the essential terms comes in with their exact sum.
            score = self.rows[np.ix_(rows, essential)] @ query[essential]
        else:
            rest, rows = order, np.arange(len(self.ids))
            score, left = np.zeros(len(rows)), below[-1] if width else 0.0
        rest = rest[::-1]
        for i in range(0, len(rest), PROBE):
            keep = score + left >= least
            rows, score = rows[keep], score[keep]
            some = rest[i: i + PROBE]
            score = score + self.rows[np.ix_(rows, some)] @ query[some]
            left -= bound[some].sum()
        keep = (score >= least) & (self.ids[rows] != own)
        rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return rows[best], score[best]


def _matrix(blobs: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and their vectors, filled with zeros to the longest; of rows that repeat
    an id the smallest vector stands."""
    kept: dict[int, np.ndarray] = {}
    for i in np.argsort(ids, kind="stable").tolist():
        v, at = np.frombuffer(blobs[i]), int(ids[i])
        if at not in kept or v.tolist() < kept[at].tolist():
            kept[at] = v
    out = np.zeros((len(kept), max(map(len, kept.values()), default=0)))
    for row, v in enumerate(kept.values()):
        out[row, : len(v)] = v
    return np.array(list(kept), np.int64), out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as packed doubles.

    Rows drop out whose id or vector is null, or that hold a null or non-finite component.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            flat = np.floor(x.flatten().to_numpy(zero_copy_only=False) * scale)
            at = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            packed = [flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for each query.

    vectors: vec_id, embedding; other columns are not touched. Queries: the rows whose vec_id is divisible by
    ``every``, in blocks against all shards. Candidates: all rows but the query's own. Ties to the
    smaller vec_id; all candidates if they are fewer than k.

    Rows with a null id, a null vector or a null or non-finite component take no part. A shorter vector
    counts as filled with zeros; an empty one scores 0. Of rows that repeat a vec_id the one
    with the smallest vector stands. Scores are exact up to 2**53, and beyond 64 bits cut to
    their range. An empty table gives an empty result.
    """
    rows = quantised(vectors, scale)
    n = vectors.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // (every * BLOCK_QUERIES)))
    spread = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    every_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = rows.withColumn("shard", spread(shards)).withColumn("block", every_of(blocks)).withColumn("kind", F.lit(0))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", every_of(shards)).withColumn("kind", F.lit(1))
    names = ["shard", "block", "kind", "vec_id", "v"]
    cells = own.select(*names).union(asked.select(*names)).repartition("shard", "block").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            kind, ids, blobs = t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(4).to_pylist()
            # The same width for both sides.
            both = [_matrix([blobs[i] for i in at], ids[at]) for at in (np.flatnonzero(kind == 0), np.flatnonzero(kind == 1))]
            if not len(both[0][0]) or not len(both[1][0]):
                continue
            width = max(both[0][1].shape[1], both[1][1].shape[1])
            (own_ids, own), (query_ids, queries) = [(i, np.pad(m, ((0, 0), (0, width - m.shape[1])))) for i, m in both]
            shard, out = Shard(own_ids, own), []
            for q, query in zip(query_ids.tolist(), queries, strict=True):
                at, scores = shard.top(query, q, k)
                out.append((np.full(len(at), q), own_ids[at], scores))
            q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
            whole = [max(LEAST, min(MOST, int(x))) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(whole, pa.int64())],
                                             names=["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
