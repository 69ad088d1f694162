"""Near duplicates against brute force, and the guarantee of the Hamming join."""

import random

import numpy as np
import pytest

from orderweave.llm import components, neardup


def brute(texts, k):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").lower().encode().split()]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(rng, n, length, most):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [1024, 12])
def test_families_of_near_copies(spark, docs_of, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    texts = family(rng, 70, 150, 14) + family(rng, 25, 400, 30) + family(rng, 3, 5, 2) + ["A b C", "a B c", "a b", None, "", "  "]
    rng.shuffle(texts)
    want, sizes = brute(texts, 4)
    rows = neardup.near_duplicates(docs_of(texts), k=4).collect()
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows}
    assert got == {i: (want[i], sizes[i], want[i] == i) for i in range(len(texts))}


def test_all_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(1)
    chunks = neardup.POSITIONS // neardup.CHUNK
    for _ in range(2000):
        wrong = rng.choice(neardup.POSITIONS, neardup.RADIUS, replace=False)
        assert np.bincount(wrong // neardup.CHUNK, minlength=chunks).min() <= 1


def test_awkward_rows(spark, awkward):
    rows = neardup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    same = [r for r in rows if r.doc_id == 50]
    assert len(same) == 2 and all(r.component_id == 50 and r.kept for r in same)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(awkward.limit(0)).count() == 0


def test_repeated_id_with_other_text(spark, docs_of):
    docs = docs_of(["b c d e f g h", "z y x w v u"], [(0, "a b c d e f g", *[None] * 7)])
    rows = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert rows == [(0, 0), (0, 0), (1, 1)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 499), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 499: 499, 500: 499}
