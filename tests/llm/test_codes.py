"""Codes of vectors against plain reckoning with all entries."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderweave.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, error long, own int, n long"


def plain(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label) with whole vectors of one length; codes, errors and codebooks."""
    ints = [(i, [int(np.floor(scale * float(c))) for c in v], label) for i, v, label in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width: (p + 1) * width]
    first = [v for _, v, _ in sorted(ints, key=lambda r: r[0])[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in ints:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out = {}
    for i, v, label in ints:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label)
    flat = ",".join(str(c) for book in books for e in book for c in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("parts,entries,rounds,scale", [(8, 16, 6, 4096), (4, 70, 2, 64), (8, 3, 3, 2)])
def test_against_plain(spark, parts, entries, rounds, scale):
    rng = random.Random(entries)
    rows = [(i * 3, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)], rng.choice([1, 2, 2, 2, None])) for i in range(160)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(20)]  # copies of one vector
    want, sha = plain(rows, parts, entries, rounds, scale)
    by_label = {}
    for code, error, label in want.values():
        by_label[label] = by_label.get(label, 0) + error
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS).repartition(3)
    got = codes.compress(df, parts, entries, rounds, scale).collect()
    assert len(got) == len(rows)
    for r in got:
        code, error, label = want[r.vec_id]
        assert (r.code, r.error, r.label, r.label_error, r.codebooks_sha256) == (code, error, label, by_label[label], sha)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(1, 9), st.sampled_from([1, 3, 50, 10 ** 6, 10 ** 15]), st.integers(0, 10 ** 6))
def test_nearest_is_exact_with_ties(entries, width, size, seed):
    rng = np.random.default_rng(seed)
    dtype = np.int64 if size < codes.SMALL else object
    book = rng.integers(-size, size + 1, (entries, width)).astype(dtype)
    x = rng.integers(-size, size + 1, (40, width)).astype(dtype)
    entry, far = codes.Slices(book).nearest(x)
    all_ = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert far.tolist() == all_.min(axis=1).tolist()
    assert entry.tolist() == [row.index(min(row)) for row in all_.tolist()]


def test_candidates_leave_entries_out():
    """The masks do the work: few of many entries are left to be reckoned with."""
    rng = np.random.default_rng(4)
    book, x = rng.integers(-1000, 1000, (64, 8)), rng.integers(-1000, 1000, (500, 8))
    slices = codes.Slices(book)
    _, far = slices.nearest(x)
    masks = slices.candidates(x, np.sqrt(far).astype(np.int64) + 1)
    assert np.bitwise_count(masks).sum() < 500 * 64 / 3


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [0.1] * 7 + [nan], 1), (4, [inf] * 8, 1), (5, [None] + [0.1] * 7, 1), (6, [], 1),
            (7, [0.25, 0.5], None), (7, [0.25, 0.5], None), (None, [0.5] * 8, 2), (8, [1e17] * 8, 2), (9, [3e38] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    got = codes.compress(df).collect()
    # 1e17 after scaling lies beyond 2**62, 3e38 too. Both entries hold 0.5 in the second part: the first is taken.
    assert sorted((r.vec_id or -1, r.code) for r in got) == [(-1, "00" * 8), (1, "00" * 8), (7, "0100" + "01" * 6), (7, "0100" + "01" * 6)]
    assert all(r.error == 0 and r.label_error == 0 for r in got)
    assert codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.where("vec_id = 2")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e13 * i, -3.0, 5e12, 0.25)], 0) for i in range(6)]
    want, sha = plain(rows, 2, 2, 3, 4096)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    for r in codes.compress(df, 2, 2, 3).collect():
        code, error, _ = want[r.vec_id]
        assert (r.code, r.error, r.codebooks_sha256) == (code, min(error, codes.MOST), sha)


def test_decoding_returns_the_entries(spark):
    rows = [(i, [i / 8.0] * 8, 0) for i in range(5)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    whole = codes.whole(df)
    books = codes.fit(whole)
    back = codes.decode(codes.encode(whole, books), books).collect()
    assert {r.vec_id: r.vector for r in back} == {i: v for i, v, _ in rows}
