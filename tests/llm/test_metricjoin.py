"""The metric-space join against brute force; its prefixes and windows lose no pair."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderweave.llm import metricjoin


def brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), len(sets[i])) for i in range(len(texts))}


def family(rng, n, length, most, base=None):
    base = base or [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def chain(rng, n, length, step):
    """Each text is near the one before; far ones share nothing."""
    words = [f"c{rng.randrange(10**6)}" for _ in range(length + n * step)]
    return [" ".join(words[i * step: i * step + length]) for i in range(n)]


def passages(rng, n, length):
    """Texts of their own words around one common passage."""
    common = [f"p{i}" for i in range(length)]
    return [" ".join([f"q{rng.randrange(10**6)}" for _ in range(length)] + common) for _ in range(n)]


def joined(df, k=5, percent=80):
    return {r.doc_id: (r.component_id, r.n_shingles) for r in metricjoin.jaccard_join(df, k, percent).collect()}


@pytest.mark.parametrize("k,percent,small", [(5, 80, False), (3, 60, True)])
def test_families_chains_and_passages(spark, docs_of, k, percent, small, monkeypatch):
    if small:  # many buckets and deals, packed in several goes
        for name, value in (("BUCKET", 900), ("DEAL", 70), ("HELD", 400)):
            monkeypatch.setattr(metricjoin, name, value)
    rng = random.Random(3)
    texts = (family(rng, 60, 150, 10) + family(rng, 25, 400, 25) + family(rng, 3, 5, 2) + chain(rng, 40, 60, 3) + passages(rng, 30, 40)
             + ["A b C", "a B c", "a b", None, "", "  "])
    rng.shuffle(texts)
    assert joined(docs_of(texts), k, percent) == brute(texts, k, percent)


def test_large_regions_are_divided_and_cut_into_cells(spark, docs_of, monkeypatch):
    """Tiny limits: divisions over tasks, windows, stuck regions in cells of two blocks."""
    monkeypatch.setattr(metricjoin, "REGION", 10)
    monkeypatch.setattr(metricjoin, "BLOCK", 10)
    monkeypatch.setattr(metricjoin, "PIVOTS", 4)
    monkeypatch.setattr(metricjoin, "LEAF", 3)
    calls = []
    inner = metricjoin.divided
    monkeypatch.setattr(metricjoin, "divided", lambda *a: calls.append(1) or inner(*a))
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    # Families that share a part of one text, so that a region holds several of them.
    texts = [t for i in range(5) for t in family(rng, 16, 90, 5, [f"f{i}-{j}" if j < 30 else w for j, w in enumerate(base)])]
    texts += chain(rng, 30, 60, 2)
    rng.shuffle(texts)
    assert joined(docs_of(texts)) == brute(texts, 5)
    assert calls


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 120), st.integers(0, 10 ** 9), st.sampled_from([80, 60, 95]))
def test_linked_sets_keep_a_common_shingle(n, seed, percent):
    """Whatever the frequencies: what both sides keep of their prefixes has an element in common."""
    rng = random.Random(seed)
    universe = rng.sample(range(10 ** 6), 400)
    rank, often = {v: rng.random() for v in universe}, {v: rng.randrange(2, 5) for v in universe}
    x = set(rng.sample(universe, n))
    y = set(x)
    while True:  # change y while it stays linked
        z = set(y)
        z.discard(rng.choice(sorted(z))) if rng.random() < 0.5 else z.add(rng.choice(universe))
        if not z or 100 * len(x & z) < percent * len(x | z):
            break
        y = z
        if rng.random() < 0.02:
            break

    def kept(s):
        length, spare = (int(v) for v in metricjoin.prefix_of(np.int64(len(s)), percent))
        prefix = sorted(s, key=rank.get)[:length]
        return set(sorted(prefix, key=lambda v: (-often[v], v))[spare:])

    assert kept(x) & kept(y)


@pytest.mark.parametrize("size", [30, 120])
def test_a_region_is_joined_whole(monkeypatch, size):
    """In memory, with and without blocks, the components are those of all pairs."""
    rng = np.random.default_rng(size)
    hashes = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = []
    for f in range(size // 10):
        base = rng.choice(hashes, 60, replace=False)
        sets += [np.unique(np.concatenate([base[rng.permutation(60)[: rng.integers(50, 60)]], rng.choice(hashes, rng.integers(0, 6))])) for _ in range(10)]
    comp = np.arange(len(sets))
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def labels(pairs):
        c = comp.copy()
        for i, j in pairs:
            c[c == c[j]] = c[i]
        return [c.tolist().index(v) for v in c.tolist()]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])]
    assert labels(metricjoin.join_region(sets, comp, 80)) == labels(every)
    block = rng.integers(0, 2, len(sets))
    found = metricjoin.join_region(sets, comp, 80, block)
    assert labels(found) == labels([(i, j) for i, j in every if block[i] != block[j]])
    assert len(found) == len(comp) - len(set(labels(found)))


def test_awkward_rows(spark, awkward):
    rows = metricjoin.jaccard_join(awkward).collect()
    assert len(rows) == awkward.count()
    same = [r for r in rows if r.doc_id == 50]
    assert len(same) == 2 and all(r.component_id == 50 for r in same)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert metricjoin.jaccard_join(awkward.limit(0)).count() == 0


def test_repeated_id_with_other_text(spark, docs_of):
    docs = docs_of(["b c d e f g h", "z y x w v u"], [(0, "a b c d e f g", *[None] * 7)])
    assert sorted((r.doc_id, r.component_id) for r in metricjoin.jaccard_join(docs).collect()) == [(0, 0), (0, 0), (1, 1)]
