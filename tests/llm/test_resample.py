"""Importance resampling against plain counting."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderweave.llm import resample


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, percent, least, seed, buckets):
    s, t, rows = collections.Counter(), collections.Counter(), []
    for f in target:
        t.update(zlib.crc32(x) % buckets for x in features(f)[1])
    for i, text in docs:
        n, found = features(text)
        rows.append((i, n, [zlib.crc32(x) % buckets for x in found]))
        s.update(rows[-1][2])
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = {}
    for i, n, found in rows:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    part = sorted((i for i, n, _ in rows if n >= least), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(part[: percent * len(part) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("percent,least,buckets", [(5, 20, 10_000), (30, 3, 50), (100, 0, 65_536)])
def test_against_plain(spark, docs_of, percent, least, buckets):
    rng = random.Random(buckets)
    vocabulary = ["Über", "naïve", "x1", "don't", "A-B", "ÑANDÚ", "日本", "a" * 90, " nb", "İ", *[f"w{i}" for i in range(60)]]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(150)] + ["same words here " * 9] * 40
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    want = plain(list(enumerate(texts)), target, percent, least, 42, buckets)
    got = resample.resample(docs_of(texts).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"),
                            percent, least, 42, buckets).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ09 .\n\x00-é日😀\x7f"), max_size=40), max_size=5))
def test_buckets_of_any_text(texts):
    n_words, n_features, found = resample.feature_buckets(pa.array(texts, pa.string()))
    cut = np.cumsum([0, *n_features])
    for i, t in enumerate(texts):
        n, want = features(t)
        assert n_words[i] == n
        assert sorted(found[cut[i]: cut[i + 1]].tolist()) == sorted(zlib.crc32(x) % resample.BUCKETS for x in want)


def test_checksums_of_runs_are_put_together():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.randbytes(rng.choice([0, 1, 7, 300, 70_000])) for _ in range(2))
        whole = resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0] ^ zlib.crc32(b)
        assert whole == zlib.crc32(a + b)


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 50)
    text = " ".join(["wort", "é" * 70, "x", "., .", "ende" * 40] * 9)
    n, want = features(text)
    n_words, _, found = resample.feature_buckets(pa.array([text]))
    assert n_words[0] == n and sorted(found.tolist()) == sorted(zlib.crc32(x) % resample.BUCKETS for x in want)


def test_awkward_rows(spark, awkward):
    target = awkward.limit(0).select("text")
    rows = resample.resample(awkward, target, 100, 1).collect()
    assert len(rows) == awkward.count()
    assert all(r.score is None and r["rank"] is None for r in rows if r.doc_id is None)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 7))
    assert all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in rows if r.doc_id in (1, 2, 3))
    assert resample.resample(awkward.limit(0), target).count() == 0
    whole = resample.drawn(awkward, target, percent=100, least_words=1)
    assert whole.columns == awkward.columns and whole.count() == 6


def test_the_draw_follows_the_target(spark, docs_of):
    """Documents in the target's words win; the draw is not the same for every seed."""
    rng = random.Random(6)
    texts = [" ".join(f"{'ab'[i % 2]}{rng.randrange(30)}" for _ in range(25)) for i in range(400)]
    target = spark.createDataFrame([(" ".join(f"a{rng.randrange(30)}" for _ in range(25)),) for _ in range(30)], "text string")
    draws = [{r.doc_id for r in resample.resample(docs_of(texts), target, 20, seed=s).where("rank is not null").collect()} for s in (1, 2)]
    assert all(len(d) == 80 and all(i % 2 == 0 for i in d) for d in draws) and draws[0] != draws[1]
