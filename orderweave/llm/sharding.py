"""Shards of near equal bytes by minimax contiguous partition of groups of equal texts.

Groups stay whole and in the order of their first document. The law: no shard can hold less than
the smallest capacity with which a greedy walk over the ordered group sizes gets by with the given
number of shards. The walk only asks for the last group that ends within a capacity, that is for
positions among running sums. These sums are a distributed table; the driver holds a bounded set
of them. Between known sums it reckons once with no cut (a capacity that suffices anyway) and once
with a cut anywhere (one below which none suffices), and fetches more sums just where the two
differ, until both binary searches meet. Then it cuts: each cut as near to equal shares as
this capacity permits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm.groups import groups
from orderweave.session import stored

#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Groups in a range of the running sum, on average; running sums that the driver asks for at once.
RANGE_GROUPS, MARKS = 50_000, 20_000


def _sums(grouped: DataFrame) -> DataFrame:
    """Add end_bytes (with the group) and start_rows (before it), in the order of first, key."""
    n = grouped.count()
    ranges = max(1, -(-n // RANGE_GROUPS))
    # The ends of the ranges: one number per range.
    ends = grouped.agg(F.percentile_approx("first", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    ends = np.unique(np.array(ends if ranges > 1 else [], np.int64))

    @F.pandas_udf("int")
    def range_of(first):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(ends, first.to_numpy(), side="left").astype(np.int32))

    ranged = stored(grouped.withColumn("range", range_of("first")), "sharding-groups")
    total = {r.range: (r.bytes, r.n) for r in ranged.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}
    before, sums = {}, np.zeros(2, np.int64)
    for r in sorted(total):
        before[r] = sums.copy()
        sums += total[r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            b, r = before[t.column(0)[0].as_py()]
            size, rows = t.column(3).to_numpy(), t.column(4).to_numpy()
            yield from pa.Table.from_arrays(
                [t.column(2), t.column(3), t.column(4), pa.array(b + np.cumsum(size)), pa.array(r + np.cumsum(rows) - rows)],
                names=["key", "bytes", "n", "end_bytes", "start_rows"]).to_batches()

    ordered = ranged.select("range", "first", "key", "bytes", "n").repartition("range").sortWithinPartitions("range", "first", "key")
    return stored(ordered.mapInArrow(run, "key binary, bytes long, n long, end_bytes long, start_rows long"), "sharding-sums")


class Marks:
    """Known running sums, and how many unknown ones lie before each."""

    def __init__(self, sums: DataFrame, marks: int = MARKS) -> None:
        self.sums, self.marks = sums, marks
        row = sums.agg(F.max("end_bytes").alias("end"), F.count("*").alias("n")).first()
        self.total = row.end or 0
        self.ends = np.array([self.total], np.int64)
        self.inner = np.array([max(row.n - 1, 0)], np.int64)

    def refine(self, gaps: np.ndarray) -> None:
        """Fetch running sums inside these gaps: the least and the largest of each of evenly spread parts.

        At most about ``marks`` sums come. Each call learns a sum of every gap that holds an
        unknown one, and what stays unknown lies in parts of at most half the gap's width.
        """
        gaps = gaps[self.inner[gaps] > 0]
        if not len(gaps):
            return
        starts = np.concatenate([[0], self.ends[:-1]])
        lo, hi = starts[gaps], self.ends[gaps]
        parts = max(2, self.marks // (2 * len(gaps)))
        picked = np.stack([lo, hi], 1)

        @F.pandas_udf("long")
        def part_of(end):  # noqa: ANN001, ANN202
            import pandas as pd

            end = end.to_numpy()
            at = np.minimum(np.searchsorted(picked[:, 1], end, side="left"), len(picked) - 1)
            low, high = picked[at, 0], picked[at, 1]
            part = np.minimum(((end - low - 1) / (high - low) * parts).astype(np.int64), parts - 1)
            return pd.Series(np.where((end > low) & (end <= high), at * parts + part, -1))

        found = self.sums.select(part_of("end_bytes").alias("part"), "end_bytes").where("part >= 0").groupBy("part").agg(
            F.min("end_bytes").alias("least"), F.max("end_bytes").alias("end"), F.count("*").alias("n")).toPandas()
        least, end, n = (found[c].to_numpy(np.int64) for c in ("least", "end", "n"))
        keep = np.ones(len(self.ends), bool)
        keep[gaps] = False
        ends = np.concatenate([self.ends[keep], least[n > 1], end])
        # Nothing lies before the least sum of a part; between it and the largest lie all but the two.
        inner = np.concatenate([self.inner[keep], np.zeros(int((n > 1).sum()), np.int64), np.maximum(n - 2, 0)])
        order = np.argsort(ends)
        self.ends, self.inner = ends[order], inner[order]

    def walk(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """Where a greedy walk cuts; it ends early where a single step is too large."""
        at, cuts = 0, []
        for _ in range(shards):
            if at >= self.total:
                break
            reach = at + capacity
            gap = int(np.searchsorted(self.ends, reach, side="right"))
            end = int(self.ends[gap - 1]) if gap else 0
            if anywhere and gap < len(self.ends) and self.inner[gap] > 0:
                end = reach
            if end <= at:
                break
            cuts.append(end)
            at = end
        return cuts

    def suffices(self, capacity: int, shards: int, anywhere: bool) -> bool:
        cuts = self.walk(capacity, shards, anywhere)
        return bool(cuts) and cuts[-1] >= self.total or not self.total

    def least(self, shards: int, anywhere: bool) -> int:
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.suffices(middle, shards, anywhere) else (middle + 1, high)
        return low

    def capacity(self, shards: int) -> int:
        """The smallest capacity that suffices, exactly."""
        self.refine(np.arange(len(self.ends)))
        while True:
            low, high = self.least(shards, True), self.least(shards, False)
            if low >= high:
                return high
            # The gaps in which a walk with any capacity from low to high may cut.
            gaps = set()
            first, last = self.walk(low, shards, True), self.walk(high, shards, True)
            for i in range(shards):
                a = min(first[i] if i < len(first) else self.total, (i + 1) * low)
                b = max(last[i] if i < len(last) else self.total, a)
                gaps.update(range(int(np.searchsorted(self.ends, a, side="left")),
                                  min(int(np.searchsorted(self.ends, b, side="left")) + 1, len(self.ends))))
            open_ = np.array(sorted(g for g in gaps if self.inner[g] > 0), np.int64)
            self.refine(open_ if len(open_) else np.flatnonzero(self.inner))

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The capacity, and ends of the shards but the last: each as near to equal shares as it permits."""
        capacity = self.capacity(shards)
        # From which sum on the rest surely fits into the shards that are left.
        latest = [self.total]
        for _ in range(shards):
            at = int(np.searchsorted(self.ends, latest[-1] - capacity, side="left"))
            latest.append(0 if latest[-1] <= capacity else int(self.ends[at]))
        earliest, at, cuts = latest[::-1], 0, []
        for i in range(1, shards):
            options = self.ends[(self.ends >= max(earliest[i], at)) & (self.ends <= at + capacity)]
            if len(options):
                at = int(options[np.argmin(np.abs(options - self.total * i / shards))])
            cuts.append(at)
        return capacity, cuts


def shard(docs: DataFrame, shards: int = 40, marks: int = MARKS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, per row of docs.

    docs: doc_id, text; other columns are not touched. marks: running sums that the driver asks
    for at once. Equal texts go to the same shard; null texts are one group, of size OVERHEAD each. Order: smallest doc_id of the group, null first,
    then a hash of the text. Slots of a shard count from 0 without gaps. Rows that repeat are rows like
    others. With fewer groups than shards some shards stay empty. An empty table gives an empty
    result.
    """
    text = F.col("text").cast("string")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key")), "sharding-rows")
    grouped = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"),
                                      F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("first"))
    sums = _sums(grouped)
    _, cuts = Marks(sums, marks).cuts(shards)
    number = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("end_bytes"))) if cuts else F.lit(0)
    placed = stored(sums.withColumn("shard", number), "sharding-placed")
    first = placed.groupBy("shard").agg(F.min("start_rows").alias("shard_start"))
    placed = placed.join(first, "shard").select("key", "shard", (F.col("start_rows") - F.col("shard_start")).alias("start"),
                                                F.ceil(F.sqrt("n")).cast("long").alias("parts"))
    # Rows of a group are numbered in about sqrt(n) parts of sqrt(n) rows, so that no task gets a large group.
    rows = rows.join(placed, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")
    offsets = counts.select("key", "part", before.alias("before"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("key", "part").orderBy("doc_id")) - 1)
    return numbered.join(offsets, ["key", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before") + F.col("nth")).cast("long").alias("slot"))
