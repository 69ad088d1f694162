"""MaxScore against all inner products."""

import math
import random

import numpy as np
import pytest

from orderweave.llm import topk


def brute(rows, k, every):
    v = {i: np.floor(np.array(x, float) * 256) for i, x in rows}
    out = {}
    for q in v:
        if q % every == 0:
            dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))  # noqa: B905, E731
            out[q] = sorted(((-dot(v[q], v[c]), c) for c in v if c != q))[:k]
    return {q: [(c, -s) for s, c in best] for q, best in out.items()}


@pytest.mark.parametrize(("shard_rows", "block"), [(4096, 1024), (37, 2)])
def test_against_all_products(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400 + i, [0.0] * 16) for i in range(5)] + [(450, [-0.3] * 16), (500, [0.0] * 16), (600, [1e-9] * 16)]
    df = spark.createDataFrame([(i, x, "label") for i, x in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in topk.top_k(df, 5, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact = [(i, np.array(x, np.float32).tolist()) for i, x in rows]
    assert {q: [best[r] for r in sorted(best)] for q, best in got.items()} == brute(exact, 5, 10)


def test_sparse_terms_are_pruned():
    rng = np.random.default_rng(5)
    rows = np.where(rng.random((2000, 40)) < 0.1, rng.integers(-90, 90, (2000, 40)), 0).astype(float)
    shard = topk.Shard(np.arange(2000), rows)
    for i in range(0, 2000, 50):
        at, scores = shard.top(rows[i], i, 5)
        want = sorted((-float(rows[j] @ rows[i]), j) for j in range(2000) if j != i)[:5]
        assert [(-s, a) for a, s in zip(at.tolist(), scores.tolist(), strict=True)] == want


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (None, [1.0, 1.0]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]),
            (3, [1.0, 2.0]), (3, [1.0, 1.0]), (4, []), (5, [3.0]), (150, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(topk.top_k(df).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score // 65536))
    assert got == {0: [(150, 5), (3, 3), (5, 3), (4, 0)], 150: [(0, 5), (3, 3), (5, 3), (4, 0)]}
    assert topk.top_k(df.limit(0)).count() == 0
