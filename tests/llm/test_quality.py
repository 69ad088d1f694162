"""Counts against a plain version; fences against their definition."""

import random
import re

from orderweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines, seen = [x for x in (text or "").split("\n") if WORD.search(x)], set()
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines), dup, len(repeat))


def test_counts(spark, docs_of):
    rng = random.Random(2)
    texts = [None, "", " \n\n ", "\n", "a\n", "a\r\na\n", "x y\x0bz\x0c w", "é ñ\u3000ü \u00a0", "\na\n\na\na"]
    texts += [" ".join(rng.choice(["a", "b", "#é", "c\n", "\n", "日本", "|"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = quality.quality(docs_of(texts), "doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_fences_follow_the_group(spark, docs_of):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda n, size=60: " ".join(word(n) for _ in range(size))
    rows = [(i, text(5), "en", "plain") for i in range(150)] + [(1000 + i, text(12), "en", "long") for i in range(150)]
    rows += [(2000, text(12), "en", "plain"), (2001, text(5), "en", "long"), (2002, text(12), "en", "rare"), (2003, text(5), None, None)]
    rows += [(2004, " ".join(f"{word(5)} ***" for _ in range(60)), "en", "plain")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    kept = {r.doc_id: r.kept for r in quality.quality(docs, "doc_id").collect()}
    assert all(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(150))
    # Twelve letters a word are usual in one source and not in the other; a rare source goes by its language.
    assert not kept[2000] and not kept[2001] and kept[2002] and kept[2003] and not kept[2004]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, k in kept.items() if k}


def test_sketches_merge(spark, docs_of):
    docs = docs_of([" ".join(f"w{i * j}" for j in range(12 + i)) for i in range(60)])
    whole = quality.sketch(quality.measure(docs, "lang", "source"))
    halves = [quality.sketch(quality.measure(docs.where(f"doc_id % 2 = {i}"), "lang", "source")) for i in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "measure", "bucket").sum("n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_bucket_error(spark):
    rows = spark.range(0, 200_000, 7).select("id", quality.bucket(quality.F.col("id")).alias("b"))
    assert rows.where("b > id or 32 * (id - b) > id").count() == 0


def test_awkward_rows(spark, awkward):
    rows = quality.quality(awkward, "doc_id").collect()
    assert len(rows) == awkward.count() and all(r.kept is not None for r in rows)
    assert quality.quality(awkward.limit(0), "doc_id").count() == 0
    assert quality.keep_good(awkward.limit(0)).count() == 0
