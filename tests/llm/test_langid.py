"""Held-out accuracy, and the scores against a plain version."""

import math
from collections import Counter

import pytest

from orderweave.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 250
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def plain(model, text):
    sums, n = [0.0] * len(model.langs), 0
    for word in langid.words_in(text):
        for order in [0, *range(langid.LONGEST, 0, -1)]:
            items = [word] if not order else langid.grams_of(word, order)
            known = [model.index[order][g] for g in items if g in model.index[order]]
            if known:
                for i in range(len(sums)):
                    sums[i] += sum(model.scores[order][k][i] for k in known) / len(known)
                n += 1
                break
    means = [s / max(n, 1) for s in sums]
    best = means.index(max(means))
    return model.langs[best], 1 / sum(10 ** (m - means[best]) for m in means)


def test_scores_are_those_of_the_plain_version(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    monkeypatch.setattr(langid, "REMEMBERED", 500)
    predictor = langid.Predictor(model)
    for row in docs.where("doc_id % 2 = 1").select("text").collect():
        lang, score = predictor(row.text)
        want, sure = plain(model, row.text)
        assert lang == want and math.isclose(score, sure, rel_tol=1e-6)


def test_word_goes_before_grams_and_long_before_short():
    model = langid.Model({("a", 0): {"abc": 5}, ("b", 0): {"xyz": 5}, ("a", 2): {"qr": 9}, ("b", 2): {" q": 1, "rs": 9},
                          ("a", 1): {"q": 3}, ("b", 1): {"q": 9}})
    assert model.word_scores("abc").tolist() == [0.0, langid.PENALTY]
    assert model.word_scores("qrs").tolist() == pytest.approx([-14 / 3, (math.log10(0.1) + langid.PENALTY + math.log10(0.9)) / 3])
    assert model.word_scores("zqz").tolist() == [0.0, 0.0]
    assert model.word_scores("日本") is None


def test_awkward_rows(spark, awkward, docs_of):
    rows = langid.identify(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "de") for r in rows if r.doc_id in (0, 5, 6))
    assert langid.identify(awkward.limit(0)).count() == 0
    nobody = langid.predict(docs_of(["words", None, "12 ½ -"]), langid.Model({}), "doc_id").collect()
    assert {r.lang_pred for r in nobody} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small, whole = langid.fit(docs, 50_000), langid.fit(docs)
    assert small.langs == whole.langs == ["de", "en", "es", "fr"]
    assert len(small.index[0]) < len(whole.index[0]) / 4


def test_a_language_with_one_short_text_keeps_its_words(spark, docs_of):
    own = "mi havas unu grandan hundon kaj du katojn"
    docs = docs_of(["one big dog and two cats have a house"] * 20, [(100, own, "eo", "s", 1, None, None, None, None)])
    model = langid.fit(docs)
    assert set(own.split()) <= set(model.index[0])
    assert langid.Predictor(model)(own)[0] == "eo"


@pytest.mark.parametrize(("words", "grams"), [(300, 200), (50_000, 20_000)])
def test_the_most_frequent_are_kept(spark, monkeypatch, words, grams):
    monkeypatch.setattr(langid, "WORDS", words)
    monkeypatch.setattr(langid, "GRAMS", grams)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null")
    counts = {}
    for row in docs.select("text", "lang").collect():
        for word in langid.words_in(row.text):
            for order in range(langid.LONGEST + 1):
                counts.setdefault((row.lang, order), Counter()).update(langid.grams_of(word, order) if order else [word])
    got, want = langid.fit(docs), langid.Model(counts, words, grams)
    assert got.index == want.index
    assert all((a == b).all() for a, b in zip(got.scores, want.scores, strict=True))
