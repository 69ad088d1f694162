"""Removal of repeats against brute force, with over-full prefixes and few buckets."""

import random

import numpy as np
import pytest

from orderweave.llm import substrings


def brute(docs):
    first = {}
    split = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < i for k in range(13)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def corpus(rng, n):
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(8)] + [["the"] * 30, [word()] * 4 + ["x"] * 9]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(40))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts


@pytest.mark.parametrize(("bucket_docs", "overfull", "held"), [(2000, 0.5, 4_000_000), (15, 1e-9, 50)])
def test_against_brute_force(spark, docs_of, monkeypatch, bucket_docs, overfull, held):
    monkeypatch.setattr(substrings, "BUCKET_DOCS", bucket_docs)
    monkeypatch.setattr(substrings, "OVERFULL", overfull)
    monkeypatch.setattr(substrings, "HELD", held)
    texts = [*corpus(random.Random(6), 150), None, "", "a b"]
    texts += texts[:10]
    rows = substrings.remove_repeats(docs_of(texts).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == brute(list(enumerate(texts)))
    for r in rows:
        assert sum(s.words for s in r.removed) == r.n_removed and all(s.words >= 13 for s in r.removed)


def test_nodes_of_a_subtree():
    four, eight = np.array([2, 1, 1, 2, 1], np.uint32), np.array([5, 5, 5, 5, 4], np.uint32)
    path = np.array([9, 7, 7, 8, 7], np.uint64)
    order, first = substrings.subtree_nodes(four, eight, path)
    assert [sorted(order[a:b].tolist()) for a, b in zip(first, [*first[1:], 5], strict=True)] == [[4], [1, 2], [3], [0]]


def test_awkward_rows(spark, awkward, docs_of):
    rows = substrings.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count() and all(r.n_removed == 0 for r in rows)
    assert substrings.remove_repeats(awkward.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([long], [(None, long, *[None] * 7), (0, long, *[None] * 7), (3, long, *[None] * 7)])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(False, 0, 0), (False, 0, 0), (False, 3, 20), (True, 0, 0)]
