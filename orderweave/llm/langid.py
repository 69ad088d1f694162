"""Language of texts by words first, backing off to ever shorter character n-grams.

A word that the model knows scores, per language, the logarithm of its relative frequency
there, or a penalty where the language lacks it. An unknown word is put between blanks and
scored by its 5-grams of characters, averaged over those that any language knows; if none is
known by its 4-grams, and so on to single characters. A text scores the mean of its words.

The model is fitted on a bounded sample of the labelled texts: all of a language, or so many
documents, drawn by a hash of doc_id, that they hold ``sample_chars`` characters on average.
Of their words and n-grams the most frequent are kept, so the model that tasks receive has a
fixed largest size per language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderweave.llm.words import steps
from orderweave.session import stored

SAMPLE_CHARS = 3_000_000
WORDS, GRAMS, LONGEST = 50_000, 20_000, 5
#: Score, as a decimal logarithm, of a word or n-gram that a language lacks.
PENALTY = -7.0
UNKNOWN = "und"
#: Unknown words whose scores a task keeps.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if words and (words[0].isalpha() or any(c.isalpha() for w in words for c in w)) else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i: i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Scores of words (order 0) and n-grams (order n) by language, in alphabetical order.

    totals: the sums of all counts by language and order, where ``counts`` lacks rare ones.
    """

    def __init__(self, counts: dict[tuple[str, int], dict[str, int]], words: int = WORDS, grams: int = GRAMS,
                 totals: dict[tuple[str, int], int] | None = None) -> None:
        self.langs = sorted({lang for lang, _ in counts})
        self.index: list[dict[str, int]] = []
        self.scores: list[np.ndarray] = []
        for order in range(LONGEST + 1):
            per_lang = [counts.get((lang, order), {}) for lang in self.langs]
            kept = [sorted(c, key=lambda g, c=c: (-c[g], g))[: grams if order else words] for c in per_lang]
            index = {g: i for i, g in enumerate(sorted(set().union(*kept)))} if kept else {}
            scores = np.full((len(index), len(self.langs)), PENALTY)
            for column, (c, names) in enumerate(zip(per_lang, kept, strict=True)):
                total = (totals or {}).get((self.langs[column], order)) or sum(c.values())
                for g in names:
                    scores[index[g], column] = math.log10(c[g] / total)
            self.index.append(index)
            self.scores.append(np.maximum(scores, PENALTY))

    def word_scores(self, word: str) -> np.ndarray | None:
        """Scores of one word; None if not even a character of it is known."""
        at = self.index[0].get(word)
        if at is not None:
            return self.scores[0][at]
        for n in range(LONGEST, 0, -1):
            known = [i for i in map(self.index[n].get, grams_of(word, n)) if i is not None]
            if known:
                return self.scores[n][known].mean(axis=0)
        return None


class Predictor:
    """Predicts text by text; remembers a bounded number of unknown words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        langs = len(self.model.langs)
        self.at = dict(self.model.index[0])
        known = len(self.at)
        self.table = np.zeros((known + REMEMBERED, langs + 1))  # the last column counts scored words
        self.table[:known, :langs] = self.model.scores[0]
        self.table[:known, langs] = 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words, langs = words_in(text), self.model.langs
        if not words or not langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(langs) + 1)
        for i in range(0, len(words), REMEMBERED // 2):
            part = words[i: i + REMEMBERED // 2]
            new = set(part).difference(self.at)
            if len(self.at) + len(new) > len(self.table):
                self.forget()
                new = set(part).difference(self.at)
            for word in new:
                row = self.at[word] = len(self.at)
                scores = self.model.word_scores(word)
                self.table[row] = 0
                if scores is not None:
                    self.table[row, :-1], self.table[row, -1] = scores, 1
            ids = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            total += self.table[ids].sum(axis=0)
        mean = total[:-1] / max(total[-1], 1)
        best = int(np.argmax(mean))  # the first in the alphabet of equal ones
        return langs[best], float(1 / np.power(10.0, mean - mean[best]).sum())


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the rows (doc_id, text, lang) whose lang and text are not null."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()
    # One number per language. A document is drawn with the share of its language.
    share = {r.lang: min(1.0, sample_chars / max(r.chars, 1)) for r in sizes}
    if not share:
        return Model({})
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < wanted * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for part in steps(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = Counter(words_in(text))
                counts.setdefault((lang, 0), Counter()).update(words)
        for (lang, _), words in list(counts.items()):
            for n in range(1, LONGEST + 1):
                grams = counts[lang, n] = Counter()
                for word, times in words.items():
                    for g in grams_of(word, n):
                        grams[g] += times
        for (lang, order), c in counts.items():
            grams = list(c)
            for i in range(0, len(grams), 50_000):
                part = grams[i: i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([order] * len(part), pa.int32()), pa.array(part),
                     pa.array([c[g] for g in part], pa.int64())], names=["lang", "order", "gram", "n"])

    counted = drawn.select("text", "lang").mapInArrow(run, "lang string, `order` int, gram string, n long")
    counted = stored(counted.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    # The least count among the most frequent; all of a language and order that has no more than are kept.
    each = Window.partitionBy("lang", "order")
    least = counted.groupBy("lang", "order", "n").agg(F.count("*").alias("grams")).select(
        "lang", "order", "n", F.sum(F.col("n") * F.col("grams")).over(each).alias("total"),
        (F.sum("grams").over(each.orderBy(F.desc("n"))) - F.col("grams")).alias("before"))
    least = least.where(F.col("before") < F.when(F.col("order") == 0, WORDS).otherwise(GRAMS))
    least = least.groupBy("lang", "order").agg(F.min("n").alias("least"), F.max("total").alias("total"))
    totals = {(r["lang"], r["order"]): r["total"] for r in least.collect()}
    counted = counted.join(least, ["lang", "order"]).where("n >= least").select("lang", "order", "gram", "n")
    counts: dict[tuple[str, int], dict[str, int]] = {(lang, 0): {} for lang in share}
    for lang, order, gram, n in zip(*[c.to_pylist() for c in counted.toArrow().columns], strict=True):
        counts.setdefault((lang, order), {})[gram] = n
    return Model(counts, WORDS, GRAMS, totals)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep``, lang_pred and score (0 to 1), per row of docs; only text is looked at.

    Null text, or one without a letter: ``und``, score 0; so is all if the model knows no
    language. A text of which no character is known gets the first language of the alphabet,
    with an even score. Ties go to the first of the alphabet. Repeated rows: each its own result. An empty
    table gives an empty result.
    """
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for part in steps(batches):
            found = [predictor(t) for t in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(len(keep))], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """One document in three, by a checksum of its id; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the documents that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), sample_chars)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, "doc_id", "held_out")
