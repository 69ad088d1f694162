"""Importance resampling of documents towards the n-gram distribution of a target table.

1. *Words.* Each text, A-Z lower-cased, goes through an untrained pre-tokeniser, a Split on a regular
   expression that removes everything between words and returns each word with its offsets.
2. *Features.* A text's words are laid out with one blank between them. The run from word i to word j
   then is the pair (begin of i, end of j); all pairs of 1 to 3 words are its features. A feature's
   bucket is the CRC-32 of its bytes modulo the number of buckets. CRC-32 is linear: that of a run is
   that of its beginning, shifted by the length of the next word, xor that of the next word, so runs
   cost a few table look-ups whatever their length.
3. *Gains.* Both tables' features are counted by bucket, per task and then over all. A bucket's gain is
   the logarithm of the ratio of its smoothed shares in the target and in the documents.
4. *Draw.* A document's weight is the sum of its features' gains. With a Gumbel number from a hash of
   its id added, the highest scores are a sample without replacement in proportion to exp(weight).
   Rows are ranked in ranges of the sorted scores; one count per range gives the ranges' first ranks.

Texts are read once: the buckets of each document's features are stored, two bytes each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from orderweave.llm.words import steps, text_bytes
from orderweave.session import stored

BUCKETS, LONGEST, SCALE = 10_000, 3, 1000
#: What stands between words of a text in which A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a longer text that go through the pre-tokeniser at once, up to the next end of a word.
PIECE = 1 << 16
#: Longer words get their checksum from the library, one by one.
LONG_WORD = 64

_split = Split(Regex(BETWEEN), behavior="removed")
_between = re.compile(BETWEEN.encode())


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _shift_tables(powers: int = 40) -> np.ndarray:
    """For each power of two n the linear map of a checksum that n zero bytes make, by byte of the checksum."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (bits >> np.uint32(8)) ^ _BYTE[bits & 0xFF]  # one zero byte
    out = np.zeros((powers, 4, 256), np.uint32)
    value = np.arange(256, dtype=np.uint32)
    for power in range(powers):
        for byte in range(4):
            for bit in range(8):
                out[power, byte] ^= np.where(value >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
        columns = _mapped(out[power], columns)
    return out


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24]


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as parts of one that n bytes follow; xor with theirs gives that of the whole."""
    crc = crc.copy()
    for power in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> power & 1)
        crc[at] = _mapped(_SHIFT[power], crc[at])
    return crc


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each of the ranges."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= LONG_WORD)
    at = at[np.argsort(-size[at], kind="stable")]
    n = size[at]
    for i in range(int(n.max(initial=0))):
        at = at[: np.searchsorted(-n, -i, side="left")]  # those longer than i
        n = n[: len(at)]
        crc[at] = (crc[at] >> 8) ^ _BYTE[(crc[at] ^ data[starts[at] + i]) & 0xFF]
    crc = ~crc
    for i in np.flatnonzero(size > LONG_WORD):
        crc[i] = zlib.crc32(data[starts[i]: ends[i]].tobytes())
    return crc


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that end between words, with their first bytes' positions."""
    start = 0
    while len(text) - start > PIECE:
        gap = _between.search(text, start + PIECE)
        if not gap:
            break
        yield start, text[start: gap.end()]
        start = gap.end()
    yield start, text[start:]


def word_offsets(text: bytes) -> np.ndarray:
    """(begin, end) of each word of a text that is lower-cased already, in bytes."""
    found = []
    for start, piece in _pieces(text):
        split = PreTokenizedString(piece.decode())
        _split.pre_tokenize(split)
        found += [(start + a, start + b) for _, (a, b), _ in split.get_splits("original", "byte")]
    return np.array(found, np.int64).reshape(-1, 2)


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; features of each text; the buckets of all features, text by text."""
    data, text_at = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    whole = data.tobytes()
    offsets = [word_offsets(whole[a:b]) + a for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
    n_words = np.array([len(o) for o in offsets], np.int64)
    if not n_words.sum():
        return n_words, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
    starts, ends = np.concatenate(offsets).T
    doc = np.repeat(np.arange(len(offsets)), n_words)
    size = ends - starts
    word = checksums(data, starts, ends)
    # Of a blank and the word, to be put behind another run.
    after = shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), size) ^ word
    runs, docs, run = [word], [doc], word
    for k in range(2, LONGEST + 1):
        run = shifted(run[:-1], size[k - 1:] + 1) ^ after[k - 1:]
        inside = doc[: len(run)] == doc[k - 1:]
        runs.append(run[inside])
        docs.append(doc[: len(run)][inside])
    docs = np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return n_words, np.bincount(docs, minlength=len(offsets)), np.concatenate(runs)[order] % np.uint32(buckets)


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (packed 16-bit numbers), per row of doc_id, text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket's number has 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            n_words, n_features, found = feature_buckets(part.column(1), buckets)
            at = np.concatenate([[0], np.cumsum(2 * n_features)])
            packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [
                None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(found.astype(np.uint16).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_features), packed.cast(pa.binary())],
                                             names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds, over all rows. One row per task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0):
                counts += np.bincount(np.frombuffer(packed.as_buffer(), np.uint16), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.where("n_features > 0").select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Per bucket: floor(scale * log of the ratio of its smoothed shares in target and source)."""
    every, wanted, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n))))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the gains of a row's features, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain[np.frombuffer(packed.as_buffer(), np.uint16)].sum()) for packed in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add rank (from 1) by falling score, ties to the smaller doc_id; and the number of rows.

    The rows are sorted over all tasks; each task numbers its own, and the driver adds up one count per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(np.arange(at, at + b.num_rows))],
                names=[*b.schema.names, "task", "nth"])
            at += b.num_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(F.desc("score"), F.asc("doc_id")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"))
    numbered = stored(dealt.mapInArrow(run, f"{schema}, task int, nth long"), "resample-ranked")
    first, before = [], 0
    for task, n in sorted(numbered.groupBy("task").agg(F.count("*").alias("n")).collect()):
        first.append((task, before))
        before += n
    firsts = rows.sparkSession.createDataFrame(first, "task int, first long")
    return numbered.join(firsts, "task").select(*rows.columns, (F.col("first") + F.col("nth") + 1).alias("rank")), before


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank, per row of docs; rank is null for what is not drawn.

    docs: doc_id, text; target: text; other columns are not touched. Drawn are ``percent`` of 100 of the
    documents with ``least_words`` words or more, rounded down, those of the highest scores, ties to the
    smaller doc_id.

    Null or empty text, or no word: no features, weight 0. A row without doc_id counts with its features
    but is not drawn: score and rank null. Rows that repeat a doc_id are drawn each for itself.
    An empty target makes the common features lose; an empty table gives an empty result.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(features(typed, buckets), "resample-features")
    gain = gains(histogram(found, buckets), histogram(features(wanted, buckets), buckets))
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
            + F.lit(0.5)) / F.lit(float(1 << 32))
    scored = stored(weighed(found, gain).withColumn(
        "score", F.col("weight") + F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln(unit)))), "resample-scored")
    taking_part = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order, n = ranked(scored.where(taking_part))
    drawn = order.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.union(scored.where(~taking_part).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that ``resample`` draws, whole; all rows of a drawn doc_id."""
    ids = stored(resample(docs, target, **options).where("rank is not null").select("doc_id").distinct(), "resample-drawn")
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)


ORACLE = r"""
with t as (select true as own, doc_id, text from documents union all select false, null, text from benchmark),
d as (select row_number() over () as row, own, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
f as (select row, own, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as f from d, range(1, 4) as k(k)),
c as materialized (select row, own, f, count(*) as n from f group by all),
-- CRC-32 by half bytes, the low one first; the table's 16 entries are those of the reversed polynomial 0xEDB88320.
x as materialized (select f, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(regexp_extract_all(hex(encode(f)), '..'),
      lambda h: [(instr('0123456789ABCDEF', h[2]) - 1)::bigint, (instr('0123456789ABCDEF', h[1]) - 1)::bigint]))),
    lambda crc, v: xor(crc >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
      3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(crc, v) & 15) + 1]::bigint))) % 10000 as b
  from (select distinct f from c)),
h as (select b, coalesce(sum(n) filter (where own), 0)::double as s, coalesce(sum(n) filter (where not own), 0)::double as t from c join x using (f) group by 1),
g as (select b, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as g from h),
w as (select row, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from c join x using (f) join g using (b) where own group by 1),
r as (select doc_id, len(w) >= 20 as part, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join w using (row) where own),
o as (select *, row_number() over (partition by part order by score desc, doc_id) as nth, count(*) over (partition by part) as n from r)
select doc_id, n_features, weight, score, case when part and nth <= 5 * n // 100 then nth end as rank from o
"""
