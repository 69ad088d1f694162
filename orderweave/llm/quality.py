"""Quality rules with thresholds that follow each language and source.

Each document is measured once. The measures of all documents that pass the base rules go
into quantile sketches: counts by bucket, where a bucket keeps the six leading binary digits
of a value (relative error at most 1/32). Sketches merge by adding counts, so they are formed
per task, then per (language, source), and these again per language and over all. The
quartiles of a group give its fences, and a document outside the fences of its group goes.

A group of fewer than ``min_docs`` documents takes the fences of its language, and a language
of fewer those of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.llm.words import range_hashes, steps, words_of
from orderweave.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 100

#: measure: numerator, denominator, scale; fences reach so many spreads beyond the quartiles,
#: a spread being the distance of the quartiles or, if larger, the least spread.
MEASURES = {
    "word_length": ("word_chars", "n_words", 1000),
    "symbols": ("n_symbols", "n_words", 10000),
    "dup_lines": ("n_dup_lines", "n_lines", 10000),
    "repeats": ("n_repeat_words", "n_words", 10000),
}
FENCES = {
    "word_length": {"reach": 5, "least_spread": 300, "low": True},
    "symbols": {"reach": 5, "least_spread": 300, "low": False},
    "dup_lines": {"reach": 5, "least_spread": 600, "low": False},
    "repeats": {"reach": 5, "least_spread": 380, "low": False},
}
#: The measures of short texts vary more: fences of a text of n words stand farther out by
#: SHORT / n of their reach.
SHORT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _measure(texts: pa.Array) -> list[np.ndarray]:
    w = words_of(texts)
    n, data = len(w.text_at) - 1, w.data
    doc_of = lambda at: np.searchsorted(w.text_at, at, side="right") - 1
    per_doc = lambda docs: np.bincount(docs, minlength=n)[:n]
    # Code points in words: all bytes of words but continuation bytes.
    follows = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    chars = (w.ends - w.starts) - (follows[w.ends] - follows[w.starts])
    word_chars = np.bincount(w.doc, weights=chars, minlength=n)[:n].astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    symbols = per_doc(doc_of(np.flatnonzero(is_symbol[data])))
    # Lines: cut at \n and at the ends of texts; only those with a word count.
    cuts = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([w.text_at[:-1], cuts + 1]))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data))
    stops = stops - ((stops > begins) & (data[stops - 1] == 10) if len(stops) else 0)
    with_word = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begins)
    begins, stops = begins[with_word], stops[with_word]
    line_doc = doc_of(begins)
    lines = per_doc(line_doc)
    keys = range_hashes(data.astype(np.uint64) + np.uint64(1), begins, stops)
    order = np.lexsort((keys, line_doc))
    again = np.zeros(len(order), bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = per_doc(line_doc[order][again])
    # Words in windows that stand twice or more in the text.
    grams, at = w.grams(WINDOW)
    gram_doc = w.doc[at]
    order = np.lexsort((grams, gram_doc))
    same = (grams[order][1:] == grams[order][:-1]) & (gram_doc[order][1:] == gram_doc[order][:-1])
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    twice = twice[:-1] | twice[1:]
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(marks, at[order[twice]], 1)
    np.add.at(marks, at[order[twice]] + WINDOW, -1)
    repeat = per_doc(w.doc[np.cumsum(marks)[:-1] > 0])
    return [w.counts, word_chars, symbols, lines, dup_lines, repeat]


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of each document beside the columns ``keep``. A null text has no words."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]
    schema = ", ".join(fields + [f"{c} long" for c in COUNTS])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            columns = [part.column(i) for i in range(width)]
            columns += [pa.array(c.astype(np.int64)) for c in _measure(part.column(width))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS])

    return kept.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_measures(measured: DataFrame) -> DataFrame:
    return measured.withColumns({
        name: F.expr(f"{over} * {scale} div greatest({under}, 1)")
        for name, (over, under, scale) in MEASURES.items()})


def bucket(value: Column) -> Column:
    """Values below 64 as they are; above, the six leading binary digits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one mergeable sketch per group and measure."""
    long = with_measures(measured.where(~base_failed())).select(
        "lang", "source", F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x"))
    return long.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per (level, lang, source) one row with low_, high_ and reach_ of each measure.

    Level 0 is the group, 1 its language, 2 all documents; only groups of at least
    ``min_docs`` documents, but all documents always.
    """
    level = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source")) for i, (lang, source) in
        enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), F.lit(None).cast("string")),
                   (F.lit(None).cast("string"), F.lit(None).cast("string"))])]))
    merged = sketches.select(level.alias("g"), "measure", "bucket", "n").groupBy(
        "g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))
    # A sketch has at most 64 + 32 * 58 buckets, so each is one bounded row.
    rows = merged.groupBy("level", "lang", "source", "measure").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("docs"))
    rows = rows.where((F.col("level") == 2) | (F.col("docs") >= min_docs))

    def quantile(percent: int) -> str:
        return (f"aggregate(s, struct(0L as seen, -1L as at), (a, x) -> struct(a.seen + x.n as seen, "
                f"if(a.at < 0 and 100 * (a.seen + x.n) >= {percent} * docs, x.bucket, a.at) as at), a -> a.at)")

    rows = rows.withColumns({"q1": F.expr(quantile(25)), "q3": F.expr(quantile(75))})
    picked = []
    for name, f in FENCES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(f["least_spread"]))
        mine = F.col("measure") == name
        reach = (f["reach"] * spread).cast("long")
        low = F.col("q1") - reach if f["low"] else F.lit(-(1 << 40))
        picked += [F.max(F.when(mine, low)).alias(f"low_{name}"),
                   F.max(F.when(mine, F.col("q3") + reach)).alias(f"high_{name}"),
                   F.max(F.when(mine, reach)).alias(f"reach_{name}")]
    return rows.groupBy("level", "lang", "source").agg(*picked)


def judge(measured: DataFrame, fenced: DataFrame) -> DataFrame:
    """Add base_failed and kept. The fences join on (lang, source), nulls being a value."""
    names = [f"{side}_{m}" for m in MEASURES for side in ("low", "high", "reach")]
    level = lambda i, *on: fenced.where(F.col("level") == i).select(
        *[F.col(c).alias(f"f_{c}") for c in on], F.struct(*names).alias(f"f{i}"))
    eq = lambda c: F.col(c).eqNullSafe(F.col(f"f_{c}"))
    out = with_measures(measured).join(level(0, "lang", "source"), eq("lang") & eq("source"), "left")
    out = out.drop("f_lang", "f_source").join(level(1, "lang"), eq("lang"), "left").drop("f_lang")
    whole = fenced.where(F.col("level") == 2).select(F.first(F.struct(*names)))
    out = out.withColumn("f", F.coalesce("f0", "f1", whole.scalar()))
    slack = {m: F.expr(f"f.reach_{m} * {SHORT} div greatest(n_words, 1)") for m in MEASURES}
    inside = [F.col(m).between(F.col(f"f.low_{m}") - slack[m], F.col(f"f.high_{m}") + slack[m]) for m in MEASURES]
    good = inside[0]
    for x in inside[1:]:
        good = good & x
    return out.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(good, F.lit(True))).drop("f", "f0", "f1", *MEASURES)


def quality(docs: DataFrame, *keep: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """Measure, sketch and judge all documents.

    docs: text, lang, source and the columns ``keep``; other columns are not touched. One
    row per input row: ``keep``, lang, source, the counts, base_failed, kept.

    Null or empty text: no words, so base_failed. Null lang or source: a group like others.
    Repeated rows: judged each, and counted each in the sketches. Empty table: empty result.
    If no document passes the base rules, none is kept.
    """
    clean = docs.select(*keep, F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), "text")
    measured = stored(measure(clean, *keep, "lang", "source"), "quality-measures")
    return judge(measured, fences(sketch(measured), min_docs))


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with their columns unchanged.

    Texts are measured twice, for the sketches and for the verdict, so that they are never
    shuffled: only the fences, a few rows per group, meet the rows.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                        F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), "text")
    fenced = stored(fences(sketch(measure(plain, "lang", "source")), min_docs), "quality-fences")
    own = [f"c{i}" for i in range(len(names))]
    judged = judge(measure(plain, *own, "lang", "source"), fenced).where("kept")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


ORACLE = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i
      from (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
g as (select doc_id, i, {w: w, a: lead(w, 1) over o, b: lead(w, 2) over o, c: lead(w, 3) over o, e: lead(w, 4) over o} as g,
             lead(i, 4) over o as whole from w window o as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g where whole is not null) where n > 1),
r as (select doc_id, count(distinct i + k) as n from twice, range(5) as k(k) group by 1),
l as (select doc_id, count(*) as n, count(*) - count(distinct line) as dup
      from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, d.lang, d.source, count(w.w) as n_words, coalesce(sum(length(w.w)), 0)::bigint as word_chars,
             length(regexp_replace(any_value(t), '[^#*$%&|<>]', '', 'g')) as n_symbols
      from d left join w using (doc_id) group by 1, 2, 3),
c as (select m.*, coalesce(l.n, 0) as n_lines, coalesce(dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
             n_words < 10 or 100 * coalesce(r.n, 0) > 20 * n_words as base_failed
      from m left join l using (doc_id) left join r using (doc_id)),
v as (select c.*, word_chars * 1000 // greatest(n_words, 1) as word_length, n_symbols * 10000 // greatest(n_words, 1) as symbols,
             n_dup_lines * 10000 // greatest(n_lines, 1) as dup_lines, n_repeat_words * 10000 // greatest(n_words, 1) as repeats from c),
x as (unpivot (select lang, source, word_length::bigint as word_length, symbols::bigint as symbols, dup_lines::bigint as dup_lines,
                      repeats::bigint as repeats from v where not base_failed)
      on word_length, symbols, dup_lines, repeats into name measure value val),
b as (select lang, source, measure, ((val >> greatest(length(bin(val)) - 6, 0)) << greatest(length(bin(val)) - 6, 0)) as bucket from x),
lv as (select 0 as level, lang, source, measure, bucket from b union all select 1, lang, null, measure, bucket from b
       union all select 2, null, null, measure, bucket from b),
q as (select level, lang, source, measure, quantile_disc(bucket, 0.25) as q1, quantile_disc(bucket, 0.75) as q3, count(*) as n
      from lv group by 1, 2, 3, 4 having level = 2 or count(*) >= 100),
k as (select level, lang, source, measure, q1, q3, case measure when 'dup_lines' then 600 when 'repeats' then 380 else 300 end as least from q),
f as (select level, lang, source, map_from_entries(list({k: measure, v: {
               lo: case when measure = 'word_length' then q1 - 5 * greatest(q3 - q1, least) else -1099511627776 end,
               hi: q3 + 5 * greatest(q3 - q1, least), re: 5 * greatest(q3 - q1, least)}})) as t from k group by 1, 2, 3),
j as (select v.*, coalesce(fa.t, fb.t, fc.t) as t, greatest(n_words, 1) as n from v
      left join (select * from f where level = 0) fa on v.lang is not distinct from fa.lang and v.source is not distinct from fa.source
      left join (select * from f where level = 1) fb on v.lang is not distinct from fb.lang
      left join (select * from f where level = 2) fc on true)
select doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, not base_failed
       and word_length between t['word_length'].lo - t['word_length'].re * 20 // n and t['word_length'].hi + t['word_length'].re * 20 // n
       and symbols <= t['symbols'].hi + t['symbols'].re * 20 // n and dup_lines <= t['dup_lines'].hi + t['dup_lines'].re * 20 // n
       and repeats <= t['repeats'].hi + t['repeats'].re * 20 // n as kept
from j
"""
