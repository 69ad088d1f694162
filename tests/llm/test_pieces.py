"""Segmentations against an exhaustive search, and round trips."""

import random

import pytest

from orderweave.llm import pieces
from orderweave.llm.pieces import BLANK, UNIT, Encoder, Vocabulary, changed, decoded


@pytest.fixture(scope="module")
def public():
    return Vocabulary.of()


def small(rng=None):
    words = [BLANK, "a", "b", "c", "ab", "bc", "abc", "ca", BLANK + "a", BLANK + "ab", "bb", "."]
    found, names = {}, [b""] * 256
    for i, w in enumerate(words):
        found[w] = (256 + i, -(rng.choice([1, 2, 3, 5]) if rng else i + 1) * UNIT)
        names.append(w.replace(BLANK, " ").encode())
    names[:256] = [bytes([i]) for i in range(256)]
    return Vocabulary(found, list(range(256)), names)


def every(v, text):
    """All segmentations: score and ids."""
    full = BLANK + text.replace(" ", BLANK)
    out = [[(0, ())]]
    for j in range(1, len(full) + 1):
        out.append([])
        for i in range(j):
            piece = full[i:j]
            if piece in v.pieces:
                pid, s = v.pieces[piece]
                out[j] += [(a + s, (*b, pid)) for a, b in out[i]]
            elif j == i + 1:
                data = piece.encode()
                out[j] += [(a + v.byte_score * len(data), b + tuple(data)) for a, b in out[i]]
    return out[-1]


@pytest.mark.parametrize("split", [64, 2])
def test_n_best_are_those_of_an_exhaustive_search(monkeypatch, split):
    monkeypatch.setattr(pieces, "SPLIT", split)
    rng = random.Random(4)
    for _ in range(150):
        v = small(rng)
        n = rng.choice([1, 2, 3, 5, 8])
        text = "".join(rng.choice("aabbc. é") for _ in range(rng.randrange(1, 9)))
        score, ids, more = Encoder(v, n)(text)
        got = [(score, tuple(ids))] + [(s, tuple(changed(ids, c))) for s, c in more]
        want = sorted(every(v, text), key=lambda x: -x[0])
        assert [g[0] for g in got] == [w[0] for w in want[:n]]
        assert len({g[1] for g in got}) == len(got) and set(got) <= set(want)
        assert all(decoded(v.names, g[1]) == text for g in got)


def test_ties_go_by_ids_from_the_end():
    v = small(random.Random(1))
    rng = random.Random(2)
    for _ in range(80):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        score, ids, more = Encoder(v, 6)(text)
        want = sorted(every(v, text), key=lambda x: (-x[0], x[1][::-1]))[:6]
        assert [(score, tuple(ids))] + [(s, tuple(changed(ids, c))) for s, c in more] == want


def test_all_texts_come_back(public):
    rng = random.Random(9)
    e = Encoder(public)
    alphabet = "ab  \n\t.,!▁é日\U0001F600\x00'\"(n"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        score, ids, more = e(text)
        assert decoded(public.names, ids) == text
        assert all(decoded(public.names, changed(ids, c)) == text and s <= score for s, c in more)
    assert e("") == (0, [], [])
    assert decoded(public.names, e("a" * 30_000)[1]) == "a" * 30_000


def test_what_a_task_has_met_does_not_matter(public, monkeypatch):
    texts = ["one two three", "the theory of it", "one two", "x" * 90]
    want = [Encoder(public)(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    e = Encoder(public)
    assert [e(t) for t in texts * 2] == want * 2


def test_texts_of_a_step_come_as_arrays():
    rng = random.Random(11)
    texts = ["", *["".join(rng.choice("aabbc. é") for _ in range(rng.randrange(1, 9))) for _ in range(40)], "", "é", "b" * 40]
    v = small(rng)
    e = Encoder(v, 3)
    for _ in range(2):
        ids, at, score, more = e.arrays(texts)
        assert ids.dtype == "int32" and len(at) == len(texts) + 1 and at[-1] == len(ids)
        for i, t in enumerate(texts):
            one = Encoder(v, 3)(t)
            assert (score[i], ids[at[i]: at[i + 1]].tolist(), more[i]) == one
            if t and len(t) < 9:
                assert score[i] == max(w[0] for w in every(v, t))
    assert [len(x) for x in Encoder(v).arrays(["", ""])] == [0, 3, 2, 2]


def test_rows(spark, awkward, docs_of, public):
    out = pieces.encode(awkward, public, "doc_id")
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    assert all(r.ids == [] and r.score == 0 and r.more == [] for r in rows if r.doc_id in (1, 2))
    back = {r.doc_id: r.text for r in pieces.decode(out, public, "doc_id").collect()}
    assert back[6] == "über größe ñandú 日本語"
    assert pieces.encode(awkward.limit(0), public, "doc_id").count() == 0
