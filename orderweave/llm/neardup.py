"""Near duplicates by b-bit MinHash signatures and a multi-index Hamming join.

1. Each text gets its set of word shingles, a 128-bit hash of the set, and a signature of 64
   positions of 16 bits. Texts with equal sets are one class from here on.
2. Two sets of Jaccard similarity 0.8 differ in 12.8 positions on average, with a standard
   deviation of 3.2. The join finds *all* pairs that differ in at most 31 (beyond that lies
   about one pair in 10**7 at exactly 0.8, and fewer above). The positions are cut into 16
   chunks of 4; by the pigeonhole principle a pair within 31 has a chunk with at most
   floor(31 / 16) = 1 error, so it agrees on one of the chunk's four keys that leave out one
   position. 64 keys per class replace the comparison with all others.
3. Pairs from shared keys are confirmed on the full sets. First each member of a key with the
   key's leader, its smallest doc_id, which ties large groups of copies together in as many
   pairs as members. Then the members of a leader that are not yet one component meet in a
   cell, where pairs across components whose signatures are within 31 are confirmed; only
   links that merge components leave it. The members of a large leader are cut into blocks,
   and each two blocks are a cell, so that no task holds more; nothing is dropped.
4. Components of the confirmed links; the smallest doc_id names each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.components import components
from orderweave.llm.groups import groups
from orderweave.llm.words import Words, mixed, range_hashes, steps, words_of
from orderweave.session import stored

POSITIONS, CHUNK, RADIUS = 64, 4, 31
PERCENT = 80
#: Members of one leader in a block, on average; a cell holds two blocks.
BLOCK = 1024

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by (text, hash), and the text of each.

    A text of fewer than k words has its whole sequence as one shingle; without words, none.
    """
    grams, at = w.grams(k)
    docs = w.doc[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = range_hashes(w.hashes, w.first[short], w.first[short + 1]) ^ n[short].astype(np.uint64)
        grams, docs = np.concatenate([grams, whole]), np.concatenate([docs, short])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    return grams[new], docs[new]


def signatures(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: set size, two halves of the set's hash, signature (POSITIONS x uint16)."""
    texts = len(w.text_at) - 1
    sets, docs = shingle_sets(w, k)
    size = np.bincount(docs, minlength=texts)[:texts]
    out = np.zeros((texts, POSITIONS), np.uint16)
    one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        at = np.searchsorted(docs, full)
        one[full] = np.add.reduceat(mixed(sets), at)
        two[full] = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
        for p in range(POSITIONS):
            least = np.minimum.reduceat(sets * _MULTIPLY[p] + _ADD[p], at)
            out[full, p] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return size, one, two, out


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            size, one, two, sig = signatures(words_of(part.column(1), lower=True), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def keys_of(signed: DataFrame) -> DataFrame:
    """key, rep: the chunk keys of each class, with one position of the chunk left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
            reps = b.column(0).to_numpy(zero_copy_only=False)
            for chunk in range(POSITIONS // CHUNK):
                part = sig[:, chunk * CHUNK: (chunk + 1) * CHUNK]
                for out in range(CHUNK):
                    value = np.full(len(part), chunk * CHUNK + out, np.uint64)
                    for p in range(CHUNK):
                        if p != out:
                            value = mixed(value * np.uint64(1 << 16) + part[:, p])
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return signed.select("rep", "sig").mapInArrow(run, "key long, rep long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, packed: texts compressed, for joins that carry whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part in steps(batches):
            packed = [pack.compress((t or "").encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null").mapInArrow(run, "doc_id long, packed binary")


def by_bytes(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of rows with at most so many compressed bytes in columns 2 and 3, or one row."""
    sizes = np.cumsum([len(x) + len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(sizes, most + (sizes[row - 1] if row else 0), side="right")))
        yield batch.slice(row, end - row)
        row = end


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * |a and b| >= percent * |a or b|."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("packed").alias(f"text_{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for b in by_bytes(whole):
                n = b.num_rows
                held: dict[bytes, int] = {}
                sides = [[held.setdefault(t, len(held)) for t in b.column(c).to_pylist()] for c in (2, 3)]
                # Pairs of one leader share its text, which is cut into shingles once.
                sets, docs = shingle_sets(words_of(pa.array([unpack.decompress(t) for t in held], pa.large_binary()), lower=True), k)
                cut = np.searchsorted(docs, np.arange(len(held) + 1))
                part = [sets[cut[i]: cut[i + 1]] for i in range(len(held))]
                keep = np.zeros(n, bool)
                for i, (x, y) in enumerate(zip(*sides, strict=True)):
                    small, large = sorted((part[x], part[y]), key=len)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    inner = int(np.count_nonzero(large[at] == small))
                    keep[i] = 100 * inner >= percent * (len(small) + len(large) - inner)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def bits_of(sets: list[np.ndarray]) -> np.ndarray:
    """A bit map of each set, 16 bits per element of the largest but 65,536 at most."""
    width = 1 << min(16, max(9, (16 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), width), bool)
    for i, x in enumerate(sets):
        out[i, (x % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def links_in(comp: np.ndarray, block: np.ndarray, crossing: bool, sets: list[np.ndarray], sig: np.ndarray,
             percent: int) -> list[tuple[int, int]]:
    """Links that tie different components of a cell together; each found one merges two.

    A pair is looked at if its signatures are within RADIUS, and confirmed on the full sets
    unless an upper bound of the intersection already rules it out: common bits, plus the
    elements that share a bit with another of their own set.
    """
    size = np.array([len(x) for x in sets], np.int64)
    bits = bits_of(sets)
    hidden = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    comp, found = comp.copy(), []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[comp[j] != comp[i]]
        if crossing:
            j = j[block[j] != block[i]]
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        ok = np.minimum(size[i], size[j]) >= need
        j, need = j[ok], need[ok]
        ok = np.count_nonzero(sig[j] != sig[i], axis=1) <= RADIUS
        j, need = j[ok], need[ok]
        most = np.bitwise_count(bits[j] & bits[i]).sum(axis=1).astype(np.int64) + np.minimum(hidden[j], hidden[i])
        for x, least in zip(j[most >= need].tolist(), need[most >= need].tolist(), strict=True):
            if comp[x] != comp[i] and len(np.intersect1d(sets[i], sets[x], assume_unique=True)) >= least:
                found.append((i, x))
                comp[comp == comp[x]] = comp[i]
    return found


def across(members: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: confirmed links between members of a leader that are in different components."""
    rows = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "leader", "rep", F.coalesce("component", "rep").alias("comp"))
    # Two members and no more are the leader and a text that it was compared with.
    open_groups = rows.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where(
        "lo < hi and n > 2").select("leader", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(open_groups, "leader").join(texts, F.col("rep") == F.col("doc_id"))
    # A member of block i meets those of block j in the cell (least, greatest) of both.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", "packed")
    cells = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for t in groups(batches, 3):
            block, rep, comp = (t.column(c).to_numpy() for c in (3, 4, 5))
            if (comp == comp[0]).all():
                continue
            sets, sigs = [], []
            for part in steps(iter([pa.RecordBatch.from_arrays(
                    [pa.array([unpack.decompress(x) for x in t.column(6).to_pylist()], pa.large_binary())], names=["text"])])):
                w = words_of(part.column(0), lower=True)
                one, docs = shingle_sets(w, k)
                sets += np.split(one, np.searchsorted(docs, np.arange(1, part.num_rows)))
                sigs.append(signatures(w, k)[3])
            found = links_in(comp, block, t.column(1)[0].as_py() != t.column(2)[0].as_py(), sets, np.concatenate(sigs), percent)
            yield pa.RecordBatch.from_arrays([pa.array([int(rep[x]) for x, _ in found], pa.int64()),
                                              pa.array([int(rep[y]) for _, y in found], pa.int64())], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def unlinked(signed: DataFrame) -> DataFrame:
    return signed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, per row of docs.

    docs: doc_id, text; other columns are not touched. k: words per shingle.

    Null or empty text, or no word: n_shingles 0, linked with nothing. A row without doc_id is
    linked with nothing: component_id null, kept true. Rows that repeat a doc_id count as one
    document, whose text is the smallest of theirs: each row is returned, with the same values. Texts with the same set of
    shingles are linked whatever their length. An empty table gives an empty result.
    percent must be at least 80: the signatures are laid out for that.
    """
    if percent < PERCENT:
        raise ValueError(f"the signatures find pairs of {PERCENT} percent or more")
    signed = stored(sign(docs, k), "neardup-signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "neardup-classes")
    id_and_set = some.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y"))
    if not id_and_set.where("x <> y").isEmpty():
        once = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.min(F.col("text").cast("string")).alias("text"))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(
            near_duplicates(once, k, percent), "doc_id")
        return found.union(unlinked(signed.where("doc_id is null")))
    keys = keys_of(classes)
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = stored(keys.join(leaders, "key").select("leader", "rep").distinct(), "neardup-members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(packed_texts(docs).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "neardup-texts")
    star = members.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    labels = stored(components(confirmed(star, texts, k, percent), "neardup-star"), "neardup-labels")
    more = stored(across(members, labels, texts, k, percent), "neardup-more")
    if not more.isEmpty():
        # Only components that these links tie together change their names.
        at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at"))
        tied = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
            F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
        tied = stored(components(tied, "neardup-tied"), "neardup-tied")
        every = labels.union(more.select("a", "a")).union(more.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        labels = every.join(tied.select(F.col("node").alias("component"), F.col("component").alias("name")), "component", "left").select(
            "node", F.coalesce("name", "component").alias("component"))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
"""
