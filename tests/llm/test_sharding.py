"""Minimax shards against an exhaustive search."""

import collections
import itertools
import random
import zlib

import pytest

from orderweave.llm import sharding


def least_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("marks", [20_000, 8])
def test_capacity_is_the_smallest(spark, marks, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_GROUPS", 60)
    rng = random.Random(5)
    texts = ["w" * rng.choice([1, 5, 40, 300, 2000]) + str(rng.randrange(260)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.shard(docs, 7, marks).collect()
    assert len(rows) == 400
    held, slots, where = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert where.setdefault(text, r.shard) == r.shard
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.OrderedDict()
    for t in texts:
        groups[t] = groups.get(t, 0) + len(t) + 16
    best = least_capacity(list(groups.values()), 7)
    assert max(held.values()) == best
    # Contiguous in the order of first documents.
    order = [where[t] for t in groups]
    assert order == sorted(order)


def test_exact_with_few_marks(spark):
    rng = random.Random(8)
    sizes = [rng.choice([17, 18, 90, 4000, 77777]) for _ in range(3000)]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    sums = spark.createDataFrame(ends, "end_bytes long").cache()
    for shards in (3, 11):
        marks = sharding.Marks(sums, marks=40)
        assert marks.capacity(shards) == least_capacity(sizes, shards)
        assert len(marks.ends) < 2500


def sums_of(sizes):
    return list(itertools.accumulate(sizes))


def test_search_ends_and_cuts_fit_with_few_marks(spark):
    rng = random.Random(21)
    for case, (shards, marks) in enumerate([(2, 4), (5, 8), (3, 40), (9, 6)]):
        sizes = [rng.choice([17, 18, 90, 4000, 10 ** 6]) for _ in range(rng.choice([9, 60, 300]))]
        sums = spark.createDataFrame([(e,) for e in sums_of(sizes)], "end_bytes long").coalesce(1).cache()
        found = sharding.Marks(sums, marks)
        capacity, cuts = found.cuts(shards)
        assert capacity == least_capacity(sizes, shards), case
        edges = [0, *cuts, sum(sizes)]
        assert edges == sorted(edges) and max(b - a for a, b in zip(edges, edges[1:])) <= capacity
        assert set(cuts) <= {0, *sums_of(sizes)}


def test_a_large_text_before_small_ones(spark, docs_of):
    rows = sharding.shard(docs_of(["x" * 1_000_000, "y", "z"]), 2).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {0: (0, 0), 1: (1, 0), 2: (1, 1)}


def test_awkward_rows(spark, awkward):
    rows = sharding.shard(awkward, 3).collect()
    assert len(rows) == awkward.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.shard(awkward.limit(0), 3).count() == 0
