"""Exact n-gram Jaccard join in metric space: Voronoi regions of pivots, with windows.

The Jaccard distance is a metric, and a link is a distance of at most ``t`` = 0.2. Documents that share
nothing have distance 1 from each other, so pivots for the whole table would tell nothing apart. The
first regions are therefore made where distances below 1 can be at all:

1. *Classes.* Documents with equal sets of shingles are one class from here on.
2. *Regions of shared shingles.* Of the shingles in hash order each class keeps a prefix of half its set,
   counts over all documents say which of them are shared, and by how many. Of its prefix a class leaves
   out as many of the most frequent ones as it can and still share one with each partner (see
   ``prefix_of``). The classes that keep a shingle form a region, and the smallest of them is its pivot;
   regions with the same pivot are one. Two classes within ``t`` share a region.
3. *Pivots.* Each member is compared with its region's pivot on the full sets, which gives the links of
   large groups of near copies in as many comparisons as members. A region whose members are one
   component by then is done.
4. *Recursion.* Any other region gets pivots of its own. Each member goes to the Voronoi region of its
   nearest pivot, at distance ``d``, and also to every pivot within ``d + 2 t``: if x is nearest to p,
   and y within ``t`` of x is nearest to q, then d(x, q) <= t + d(y, q) <= t + d(y, p) <= 2 t + d(x, p),
   so x is in the window of q. Large regions are divided so over tasks, and again, until few members
   are left that are not in their largest component; there the division goes on in memory, to groups
   that are compared one by one. Where a pivot's window holds nearly all members, as among near copies
   of one text, division does not help. Such a region is compared directly, a large one in cells of two
   blocks, one of which holds members outside its largest component.

No task holds more than a bucket of documents, a region of ``REGION`` members or a cell of two blocks,
nothing is dropped, and only links between different components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderweave.llm.components import components
from orderweave.llm.groups import groups
from orderweave.llm.neardup import by_bytes, packed_texts, shingle_sets
from orderweave.llm.words import mixed, steps, words_of
from orderweave.session import stored

PERCENT = 80
#: Shingles of the documents in a bucket; prefix shingles in a deal, on average; those that a task holds before it packs them.
BUCKET, DEAL, HELD = 1_000_000, 1_000_000, 1_000_000
#: Members that one task takes as a region; members of a block where two blocks are a cell.
REGION, BLOCK = 1024, 1024
#: Pivots of a division over tasks, and in memory; a group of so few members is compared one by one.
PIVOTS, INNER_PIVOTS, LEAF = 64, 8, 24
#: A window with more than this share of the region's members has not divided it.
STUCK = 0.75
#: Hundredths of a set by which its prefix is longer than needed for one common shingle.
SPARE = 30


def need_of(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of shingles that a partner of a set of n shares with it."""
    return -(-percent * n // 100)


def prefix_of(n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Length of the prefix of a set of n shingles, and how many of it may be left out.

    Linked sets share ``o >= need(n)`` shingles, n being the larger size. The first ``n - o + l`` of both in
    any common order have l in common. With l = 1 + SPARE n / 100 the prefix is ``n - need(n) + l``. For a
    smaller partner of m shingles l is less by at most SPARE (n - m) / 100 + 1, while o exceeds need(m) by
    percent (n - m) / 100 - 1 or more, so that the prefixes have at least l - 1 in common with both
    values of l. Each side may leave out its l - 2 most frequent shingles: the least frequent common one
    stays on both.
    """
    spare = 1 + SPARE * n // 100
    return n - need_of(n, percent) + spare, np.maximum(spare - 2, 0)


def signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a hash of the set), prefix (packed), bucket, per row of docs.

    Documents that a task reads one after the other are a bucket, up to BUCKET shingles. So a bucket's
    shingles are packed together, into as many rows as there are deals, at any number of buckets. The
    result has to be stored, as buckets depend on how the table is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for part in steps(batches):
            w = words_of(part.column(1), lower=True)
            sets, doc = shingle_sets(w, k)
            size = np.bincount(doc, minlength=part.num_rows)[: part.num_rows]
            first = np.concatenate([[0], np.cumsum(size)])
            one, two = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                one[full] = np.add.reduceat(mixed(sets), first[full])
                two[full] = np.add.reduceat(mixed(sets ^ np.uint64(0x9E6C63D0876A9A47)), first[full])
            length, _ = prefix_of(size, percent)
            keep = np.arange(len(sets)) - first[doc] < length[doc]
            at = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=part.num_rows)[: part.num_rows] * 8)])
            packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [
                None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(sets[keep].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 packed.cast(pa.binary()), pa.array(np.full(part.num_rows, bucket))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "prefix", "bucket"])
            held += len(sets)
            if held > BUCKET:
                bucket, held = bucket + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, prefix binary, bucket long")


def _packed_rows(order_by: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of equal ``order_by``, together."""
    order = np.argsort(order_by, kind="stable")
    by, columns = order_by[order], [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(by[1:] != by[:-1]) + 1).tolist(), len(by)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield int(by[s]), [c[s:e] for c in columns]


def _dealt(prefixes: DataFrame, deals: int) -> DataFrame:
    """deal, bucket, keys, counts (packed): a task's shingles of a bucket, each once with its number of documents."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, bucket = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]))
        counts = np.diff(np.append(first, len(key))).astype(np.uint32)
        key, bucket = key[first], bucket[first]
        deal = (mixed(key) % np.uint64(deals)).astype(np.int64)
        names, bucket = np.unique(bucket, return_inverse=True)
        rows = [(int(names[both // deals]), both % deals, c) for both, c in _packed_rows(bucket * deals + deal, [key, counts])]
        for i in range(0, len(rows), 4096):
            some = rows[i: i + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for _, d, _ in some], pa.int64()), pa.array([b for b, _, _ in some], pa.int64()),
                 pa.array([c[0].tobytes() for *_, c in some], pa.binary()), pa.array([c[1].tobytes() for *_, c in some], pa.binary())],
                names=["deal", "bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            blobs = b.column(1).to_pylist()
            sizes = [len(x) // 8 for x in blobs]
            held.append((np.frombuffer(b"".join(blobs), np.uint64), np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)))
            n += sum(sizes)
            if n > HELD:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    return prefixes.select("bucket", "prefix").mapInArrow(run, "deal long, bucket long, keys binary, counts binary")


def _shared(dealt: DataFrame) -> DataFrame:
    """bucket, kind 0, rep null, n null, blob, counts: shingles of a bucket that several documents have, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            blobs = t.column(2).to_pylist()
            key = np.frombuffer(b"".join(blobs), np.uint64)
            n = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint32).astype(np.int64)
            bucket = np.repeat(t.column(1).to_numpy(), [len(x) // 8 for x in blobs])
            order = np.lexsort((bucket, key))
            key, n, bucket = key[order], n[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.minimum(np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key)))), (1 << 32) - 1).astype(np.uint32)
            # A bucket's own tasks may have sent a shingle more than once.
            keep = (total > 1) & np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            rows = list(_packed_rows(bucket[keep], [key[keep], total[keep]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()),
                 pa.array([None] * len(rows), pa.int64()), pa.array([None] * len(rows), pa.int64()),
                 pa.array([c[0].tobytes() for _, c in rows], pa.binary()), pa.array([c[1].tobytes() for _, c in rows], pa.binary())],
                names=["bucket", "kind", "rep", "n", "blob", "counts"])

    schema = "bucket long, kind int, rep long, n long, blob binary, counts binary"
    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, schema)


def _kept(together: DataFrame, percent: int) -> DataFrame:
    """key, rep, n: the shared shingles that each class keeps.

    Of a bucket come the shared shingles (kind 0), the documents that stand for classes (1), and all documents (2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            kind, every = t.column(1).to_numpy(), t.column(4).to_pylist()
            known, start = int(np.count_nonzero(kind == 0)), int(np.count_nonzero(kind < 2))
            if not known or start in (known, t.num_rows):
                continue
            key = np.frombuffer(b"".join(every[:known]), np.uint64)
            number = np.frombuffer(b"".join(t.column(5).slice(0, known).to_pylist()), np.uint32).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, number = key[order], number[order]
            rep, n = (t.column(c).slice(start).to_numpy() for c in (2, 3))
            # Each class once: the row of the document that stands for it, which may be repeated.
            rep, row_of = np.unique(rep, return_index=True)
            mine = np.isin(rep, t.column(2).slice(known, start - known).to_numpy())
            rep, row_of = rep[mine], row_of[mine]
            n, blobs = n[row_of], [every[start + i] for i in row_of.tolist()]
            _, spare = prefix_of(n, percent)
            for row in range(0, len(rep), 256):
                some = blobs[row: row + 256]
                own = np.frombuffer(b"".join(some), np.uint64)
                of = np.repeat(np.arange(row, row + len(some)), [len(x) // 8 for x in some])
                at = np.searchsorted(key, own)
                at[at == len(key)] = 0
                shared = key[at] == own
                own, of, count = own[shared], of[shared], number[at[shared]]
                # The most frequent first, ties by hash: an order that all classes have in common.
                order = np.lexsort((own, -count, of))
                own, of = own[order], of[order]
                keep = np.arange(len(of)) - np.searchsorted(of, of) >= spare[of]
                yield pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array(rep[of[keep]]), pa.array(n[of[keep]])],
                                                 names=["key", "rep", "n"])

    return together.mapInArrow(run, "key long, rep long, n long")


class Inverted:
    """Which members of a group have a shingle; sets are given as numbers of shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.size)
        self.member = member[np.argsort(every, kind="stable")]
        count = np.bincount(every)
        self.start, self.count = np.cumsum(count) - count, count

    def common(self, i: int) -> np.ndarray:
        """How many shingles each member shares with member i."""
        start, count = self.start[self.sets[i]], self.count[self.sets[i]]
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.member[at], minlength=len(self.sets))

    def compared(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances from member i, and which members it is linked with."""
        common = self.common(i)
        every = self.size + self.size[i] - common
        return 1 - common / every, 100 * common >= percent * every


def numbered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of hashes as sets of numbers from 0."""
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(number, np.cumsum([len(s) for s in sets])[:-1])


def join_region(sets: list[np.ndarray], comp: np.ndarray, percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a region that tie its components together; each one found merges two.

    block: only pairs across blocks are of interest; their region is not divided again.
    """
    comp, links = comp.copy(), []
    window = 2 * (1 - percent / 100) + 1e-9

    def merge(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if comp[j] != comp[i]:
                links.append((i, j))
                comp[comp == comp[j]] = comp[i]

    def join(members: np.ndarray) -> None:
        if (comp[members] == comp[members[0]]).all():
            return
        group = Inverted(numbered([sets[i] for i in members]))
        if len(members) > LEAF and block is None:
            pivots = np.unique(np.linspace(0, len(members) - 1, INNER_PIVOTS).astype(np.int64))
            far = []
            for p in pivots.tolist():
                distance, linked = group.compared(p, percent)
                merge(int(members[p]), members[linked])
                far.append(distance)
            far = np.stack(far)
            inside = far <= far.min(axis=0) + window
            if inside.sum(axis=1).max() <= STUCK * len(members):
                for part in inside:
                    if part.any():
                        join(members[part])
                return
        if block is None:
            # Pairs inside the largest component are linked already.
            names, count = np.unique(comp[members], return_counts=True)
            first = np.flatnonzero(comp[members] != names[np.argmax(count)])
        else:
            first = np.flatnonzero(block[members] == block[members].min())
        for i in first.tolist():
            other = comp[members] != comp[members[i]]
            if block is not None:
                other &= block[members] != block[members[i]]
            if other.any():
                _, linked = group.compared(i, percent)
                merge(int(members[i]), members[linked & other])

    join(np.arange(len(sets)))
    return links


def sets_of(packed: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts, none of them empty."""
    unpack, sets = zstandard.ZstdDecompressor(), []
    texts = pa.RecordBatch.from_arrays([pa.array([unpack.decompress(x) for x in packed], pa.large_binary())], names=["text"])
    for part in steps(iter([texts])):
        one, doc = shingle_sets(words_of(part.column(0), lower=True), k)
        sets += np.split(one, np.searchsorted(doc, np.arange(1, part.num_rows)))
    return sets


def _pairs(found: list[tuple[int, int]], rep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(rep[i]) for i, _ in found], pa.int64()),
                                       pa.array([int(rep[j]) for _, j in found], pa.int64())], names=["a", "b"])


def star(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: members that are linked with their region's pivot, on the full sets."""
    pairs = members.where("region <> rep").where(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)").select(
        F.col("region").alias("a"), F.col("rep").alias("b"))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("packed").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole):
                held: dict[bytes, int] = {}
                left, right = ([held.setdefault(t, len(held)) for t in b.column(c).to_pylist()] for c in (2, 3))
                sets = sets_of(list(held), k)
                keep = []
                for x, y in zip(left, right, strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def open_regions(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the regions that are not one component yet.

    Of a region: region_n members, of which minor_n are not in its largest component, ``major``. Only pairs
    with one of those are of interest.
    """
    rows = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "region", "rep", F.coalesce("component", "rep").alias("comp"))
    counted = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("region").agg(F.sum("n").alias("region_n"), F.max(F.struct("n", "comp")).alias("most")).select(
        "region", "region_n", F.col("most.comp").alias("major"), (F.col("region_n") - F.col("most.n")).alias("minor_n"))
    return rows, sizes.where("minor_n > 0")


def joined_regions(rows: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links inside regions of at most REGION members, one task each; larger ones in cells of two blocks.

    Of a large region each block of minor members meets all blocks.
    """
    small = F.col("region_n") <= REGION
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = sizes.select("region", "major", F.when(small, 1).otherwise(blocks(F.col("minor_n"))).alias("minors"),
                         F.when(small, 0).otherwise(blocks(F.col("region_n") - F.col("minor_n"))).alias("majors"))
    rows = rows.join(sized, "region").join(texts, F.col("rep") == F.col("doc_id"))
    is_major = (F.col("comp") == F.col("major")) & (F.col("majors") > 0)
    rows = rows.withColumn("block", F.when(is_major, F.col("minors") + F.pmod(F.xxhash64("rep"), F.greatest("majors", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("minors"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(is_major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    rows = rows.withColumn("other", F.explode(meets))
    cells = rows.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", "packed")
    cells = cells.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            comp = t.column(5).to_numpy()
            if (comp == comp[0]).all():
                continue
            crossing = t.column(1)[0].as_py() != t.column(2)[0].as_py()
            found = join_region(sets_of(t.column(6).to_pylist(), k), comp, percent, t.column(3).to_numpy() if crossing else None)
            yield _pairs(found, t.column(4).to_numpy())

    return cells.mapInArrow(run, "a long, b long")


def divided(rows: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """region, region_n, pivot, rep, linked: which members are in the Voronoi region or window of which new pivot.

    linked: the member is within the threshold of the pivot.
    """
    nth = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("rep"), "rep"))
    inside = rows.join(sizes.select("region", "region_n"), "region").select("region", "region_n", "rep")
    parts = F.ceil(F.col("region_n") / REGION).cast("int")
    pivots = inside.withColumn("nth", nth).where(F.col("nth") <= PIVOTS).drop("nth")
    every = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("kind", F.lit(0)).union(
        inside.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), parts).cast("int")).withColumn("kind", F.lit(1)))
    dealt = every.join(texts, F.col("rep") == F.col("doc_id")).select("region", "part", "kind", "rep", "region_n", "packed").repartition(
        "region", "part").sortWithinPartitions("region", "part", "kind", "rep")
    window = 2 * (1 - percent / 100) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            first = int(np.count_nonzero(t.column(2).to_numpy() == 0))
            rep = t.column(3).to_numpy()
            group = Inverted(numbered(sets_of(t.column(5).to_pylist(), k)))
            far, linked = (np.stack(x)[:, first:] for x in zip(*[group.compared(p, percent) for p in range(first)], strict=True))
            pivot, member = np.nonzero(far <= far.min(axis=0, initial=1) + window)
            yield pa.RecordBatch.from_arrays(
                [t.column(c).combine_chunks().take(pa.array(first + member)) for c in (0, 4)] +
                [pa.array(rep[pivot]), pa.array(rep[first + member]), pa.array(linked[pivot, member])],
                names=["region", "region_n", "pivot", "rep", "linked"])

    return dealt.mapInArrow(run, "region long, region_n long, pivot long, rep long, linked boolean")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more links; only components that these tie together change their names."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at"))
    tied = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
    names = stored(components(tied, "metricjoin-tied"), "metricjoin-tied")
    every = labels.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
    return every.join(names.select(F.col("node").alias("component"), F.col("component").alias("name")), "component", "left").select(
        "node", F.coalesce("name", "component").alias("component"))


def linked_components(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component of the links in all regions."""
    labels = stored(components(star(members, texts, k, percent), "metricjoin-star"), "metricjoin-labels")
    members = members.select("region", "rep")
    while True:
        rows, sizes = open_regions(members, labels)
        sizes = stored(sizes, "metricjoin-open")
        rows = stored(rows.join(sizes.select("region"), "region", "left_semi"), "metricjoin-rows")
        divide = F.col("minor_n") > BLOCK
        joined = joined_regions(rows, sizes.where(~divide), texts, k, percent)
        large = sizes.where(divide)
        if large.isEmpty():
            links = stored(joined, "metricjoin-links")
            return labels if links.isEmpty() else merged(labels, links)
        parts = stored(divided(rows, large, texts, k, percent), "metricjoin-parts")
        to_pivots = parts.where("linked and pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        # A window with nearly all members: the pivots do not divide this region, it is joined as it is.
        stuck = parts.groupBy("region", "pivot").agg(F.count("*").alias("n"), F.first("region_n").alias("region_n")).where(
            F.col("n") > STUCK * F.col("region_n")).select("region").distinct()
        stuck = stored(stuck, "metricjoin-stuck")
        links = stored(joined.union(to_pivots), "metricjoin-links")
        labels = stored(merged(labels, links), "metricjoin-labels") if not links.isEmpty() else labels
        again, sizes = open_regions(rows.join(stuck, "region").select("region", "rep"), labels)
        whole = stored(joined_regions(again, sizes, texts, k, percent), "metricjoin-whole")
        labels = stored(merged(labels, whole), "metricjoin-labels") if not whole.isEmpty() else labels
        members = parts.join(stuck, "region", "left_anti").select(
            F.xxhash64("region", "pivot").alias("region"), "rep")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), per row of docs.

    docs: doc_id, text; other columns are not touched. k: words per shingle. Two documents are linked when
    100 * |a and b| >= percent * |a or b|.

    Null or empty text, or no word: n_shingles 0, linked with nothing. A row without doc_id is linked with
    nothing, component_id null. Rows that repeat a doc_id count as one document, whose text is the
    smallest of theirs: each row is returned, with the same values. An empty table gives an empty result.
    """
    if not SPARE < percent <= 100:
        raise ValueError(f"prefixes are laid out for more than {SPARE} percent")
    every = stored(signed(docs, k, percent), "metricjoin-sets")
    some = every.where("n_shingles > 0 and doc_id is not null")
    id_and_set = some.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y"))
    if not id_and_set.where("x <> y").isEmpty():
        once = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.min(F.col("text").cast("string")).alias("text"))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(
            jaccard_join(once, k, percent), "doc_id")
        lost = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
        return found.select("doc_id", "n_shingles", "component_id").union(lost)
    sets = stored(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "bucket")).alias("first")).select(
        "set_a", "set_b", "n_shingles", F.col("first.doc_id").alias("rep"), "first.bucket"), "metricjoin-classes")
    total = some.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    none = lambda t: F.lit(None).cast(t)
    prefixes = some.select("bucket", F.lit(2).alias("kind"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"),
                           F.col("prefix").alias("blob"), none("binary").alias("counts"))
    reps = sets.select("bucket", F.lit(1), "rep", none("long"), none("binary"), none("binary"))
    shared = _shared(_dealt(some.select("bucket", "prefix"), max(1, -(-total // DEAL))))
    together = shared.union(reps).union(prefixes).repartition("bucket").sortWithinPartitions("bucket", "kind")
    kept = stored(_kept(together, percent), "metricjoin-kept")
    pivots = kept.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("c")).where("c > 1").select(
        "key", F.col("pivot.rep").alias("region"), F.col("pivot.n").alias("pivot_n"))
    members = stored(kept.join(pivots, "key").select("region", "pivot_n", "rep", "n").distinct(), "metricjoin-members")
    wanted = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "metricjoin-wanted")
    texts = stored(packed_texts(docs).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "metricjoin-texts")
    labels = linked_components(members, texts, k, percent)
    named = sets.join(labels, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("name"))
    out = every.drop("prefix", "bucket").join(named, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id"))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id from m left join n using (doc_id)
"""
