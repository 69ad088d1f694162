"""Compression of vectors to codes: one codebook per part, entries found by slice and intersect.

A vector's components become integers and are cut into equal parts. Each part position has a
codebook, and a part's code is its nearest entry. That entry is found without looking at all of them:

1. Per dimension the entries' coordinates stand sorted. With the sorted coordinates come prefix masks:
   mask ``i`` has a bit for each of the first ``i`` entries in this order.
2. The distance to a probed entry, the nearest one along the dimension in which the codebook is
   widest, is the initial radius. In each dimension the entries within the radius are a slice of the
   sorted coordinates, found by two binary searches; its entries are the later prefix mask without the
   earlier one.
3. The masks of all dimensions are intersected. What is left holds each entry that is as near as the
   probed one, or nearer, so distances are reckoned for these candidates only and the result is exact,
   ties included.

Codebooks are fitted in rounds. Tasks assign their rows and send sums and counts per entry and
position, so that the shuffle and the driver see a number of rows that depends on the codebooks, not
on the vectors; the driver holds the codebooks, which every task gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.session import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this size go through 64-bit arithmetic: squares of differences of 8,192 such components fit.
SMALL = 1 << 24
#: Larger ones are not taken: doubles hold them, 64-bit integers don't.
LARGEST = float(1 << 62)
MOST = (1 << 63) - 1
#: Vectors that a task handles in a step; copies of a label's sum where it is joined back.
STEP_ROWS, SALT = 2048, 16


class Slices:
    """The entries of a codebook, sorted along each dimension, with masks of their prefixes."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        count, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        self.words = -(-count // 64)
        self.prefix = np.zeros((width, count + 1, self.words), np.uint64)
        for d in range(width):
            for i, entry in enumerate(self.order[:, d].tolist()):
                self.prefix[d, i + 1] = self.prefix[d, i]
                self.prefix[d, i + 1, entry // 64] |= np.uint64(1 << entry % 64)
        spread = self.sorted[-1] - self.sorted[0] if width else np.zeros(0)
        self.widest = int(np.argmax(spread.astype(float))) if width else 0

    def probe(self, x: np.ndarray) -> np.ndarray:
        """For each row the entry nearest along the widest dimension."""
        line, at = self.sorted[:, self.widest], x[:, self.widest]
        right = np.minimum(np.searchsorted(line, at), len(line) - 1)
        left = np.maximum(right - 1, 0)
        nearer = np.where(abs(line[left] - at) <= abs(line[right] - at), left, right)
        return self.order[nearer, self.widest]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bit masks of the entries within the radius of each row in every dimension."""
        masks = np.full((len(x), self.words), np.uint64(MOST * 2 + 1))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            masks &= self.prefix[d, high] & ~self.prefix[d, low]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the nearest entry, of equal ones the first, and the squared distance."""
        if not len(x) or not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        gap = x - self.entries[self.probe(x)]
        # Whole numbers: a difference is at most the root, which is taken a little too large.
        radius = (np.sqrt((gap * gap).sum(axis=1).astype(float)) * (1 + 1e-9)).astype(np.int64) + 1
        masks = self.candidates(x, radius if x.dtype != object else radius.astype(object))
        entry = np.arange(len(self.entries))
        row, of = np.nonzero(masks[:, entry // 64] >> (entry % 64).astype(np.uint64) & np.uint64(1))
        gap = x[row] - self.entries[of]
        far = (gap * gap).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(far, first)
        best = np.flatnonzero(far == least[row])
        best = best[np.searchsorted(row[best], np.arange(len(x)))]
        return of[best], least


@dataclass
class Codebooks:
    """Integer entries by part: entries[part][entry] lists ``width`` components."""

    entries: list[list[list[int]]]
    width: int

    @property
    def sha256(self) -> str:
        flat = ",".join(str(c) for part in self.entries for entry in part for c in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def slices(self, dtype: type) -> list[Slices]:
        return [Slices(np.array(part, dtype).reshape(len(part), self.width)) for part in self.entries]

    @property
    def largest(self) -> int:
        return max((abs(c) for part in self.entries for entry in part for c in entry), default=0)

    def assign(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By part: the parts of these rows, their codes and squared distances."""
        small = self.largest < SMALL and (not rows.size or int(abs(rows).max()) < SMALL)
        rows = rows if small else rows.astype(object)
        for p, slices in enumerate(self.slices(np.int64 if small else object)):
            x = rows[:, p * self.width: (p + 1) * self.width]
            yield x, *slices.nearest(x)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component x as a double.

    Rows drop out whose vector is null or empty or holds a null or non-finite component, or one that
    is 2**62 or more after scaling.
    """
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(LARGEST / scale)), F.lit(False)))
    return vectors.where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).cast("array<bigint>").alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows and their vectors, filled with zeros to the width."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(start, STEP_ROWS)
            lists = part.column(column)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.zeros((part.num_rows, width), np.int64)
            rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield part, rows


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The vectors of the smallest ids, cut into parts; of rows that repeat an id the smallest vector."""
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n or 0
    width = -(-longest // parts)
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.col("vec_id").isin(known) if known else F.lit(False)
    if len(known) < len(ids):
        wanted = wanted | F.col("vec_id").isNull()
    seeds = rows.where(wanted).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).collect()
    full = [[*r.v, *[0] * (width * parts - len(r.v))] for r in seeds]
    return Codebooks([[v[p * width: (p + 1) * width] for v in full] for p in range(parts)], width)


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, entries become the floor of their parts' means."""
    parts, width = len(books.entries), books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for _, matrix in _matrices(batches, 0, parts * width):
            for p, (x, code, _) in enumerate(books.assign(matrix)):
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                counts = np.diff(np.append(first, len(code)))
                for entry, total, n in zip(used.tolist(), np.add.reduceat(x[order], first), counts.tolist(), strict=True):
                    held = sums.setdefault((p, entry), [0, [0] * width])
                    held[0] += n
                    held[1] = [a + int(b) for a, b in zip(held[1], total, strict=True)]
        found = [(p, e, i, total, n) for (p, e), (n, totals) in sums.items() for i, total in enumerate(totals)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)],
                                             names=["part", "entry", "pos", "total", "n"])

    sent = rows.select("v").mapInArrow(run, "part int, entry int, pos int, total decimal(38,0), n long")
    means = sent.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    entries = [[list(entry) for entry in part] for part in books.entries]
    for r in means:
        entries[r.part][r.entry][r.pos] = int(r.total) // r.n
    return Codebooks(entries, width)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for the rows of ``whole``, which should be stored: each round reads them once."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part")
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books.entries[0] else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (an index per part), error: squared distances summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _matrices(batches, 2, len(books.entries) * books.width):
            found = [(code, far) for _, code, far in books.assign(matrix)]
            error = [min(int(e), MOST) for e in sum(far for _, far in found)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.int32)
            at = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(codes.reshape(-1))), pa.array(error, pa.int64())],
                names=["vec_id", "label", "codes", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Add ``vector``: the entries that the codes name, scaled back."""
    entries = books.entries
    flat = F.lit([[[c / scale for c in entry] for entry in part] for part in entries])
    return coded.withColumn("vector", F.flatten(F.transform("codes", lambda code, p: flat[p][code])))


def label_errors(coded: DataFrame) -> DataFrame:
    """Add label_error: the error summed over rows of equal label; rows without label are one group."""
    totals = stored(coded.groupBy(F.col("label").alias("at")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "codes-labels")
    # Spark sends small sums to all tasks; with very many labels a hot one is dealt over SALT tasks.
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALT)).cast("int"))
    found = salted.join(totals, F.col("label").eqNullSafe(F.col("at")) & (F.col("own") == F.col("salt")))
    return found.select(*coded.columns, F.least(F.col("total"), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, codes, error, code (hex), label_error, codebooks_sha256, per row that takes part.

    vectors: vec_id, embedding, label; other columns are not touched. Rows take part as ``whole`` says:
    not those whose vector is null, empty, or holds a null, non-finite or unrepresentable component.
    Vectors count as filled with zeros to the longest, and that to a multiple of ``parts``. Rows without
    vec_id count as those of the largest one. Rows that repeat a vec_id are each coded; the smallest
    vector of an id stands in the first codebook. Fewer ids than entries make a smaller codebook. Of
    equally near entries the first is taken, and unused ones stay. Errors beyond 64 bits are cut to
    their range. An empty table gives an empty result.
    """
    rows = stored(whole(vectors, scale), "codes-rows")
    books = fit(rows, parts, entries, rounds)
    coded = stored(encode(rows, books), "codes-coded")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(coded).withColumn("code", code).withColumn("codebooks_sha256", F.lit(books.sha256))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select id, part, entry, d from (
  select id, x.part, entry, sum((v - c) * (v - c)) as d from x join c{i} c on x.part = c.part and x.pos = c.pos group by all)
  qualify row_number() over (partition by id, part order by d, entry) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} as (select x.part, entry, pos, sum(v) as s, count(*) as n from x join a{i} a on x.id = a.id and x.part = a.part group by all),
c{i + 1} as materialized (select c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c) as c
  from c{i} c left join m{i} m on c.part = m.part and c.entry = m.entry and c.pos = m.pos)""")
    return f"""
with r as (select vec_id as id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select id, unnest(v) as v, generate_subscripts(v, 1) - 1 as i, len(v) // {parts} as w from r),
x as materialized (select id, i // w as part, i % w as pos, v from u),
o as (select id, row_number() over (order by id) - 1 as entry from r),
c0 as (select part, entry, pos, v as c from x join o using (id) where entry < {entries}),
{",".join(steps)},
e as (select id, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(d) as error from a{rounds} group by 1),
h as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, pos)) as h from c{rounds})
select id as vec_id, code, error::bigint as error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256
from e join r using (id), h
"""


ORACLE = _oracle()
