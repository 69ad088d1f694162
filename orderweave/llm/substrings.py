"""Removal of word passages that stand in an earlier document, by prefix-partitioned suffix trees.

A suffix starts at each word and is followed to the wanted depth, 13 words: the union of the
13-word windows that repeat is the union of all longer repeats. Trees are built for groups of
suffixes, over all documents:

1. *Filter.* Of the eight 6-word runs in a window the one with the least hash is its anchor.
   Equal windows have equal anchors, so a suffix whose anchor stands in one document only can
   share no deep node and needs no tree. Only distinct anchors travel, packed, with the bucket
   of their documents.
2. *Prefixes.* The windows of all documents are counted by slots of their 4-word and 8-word
   prefixes. A prefix whose slot is too full for a group is lengthened, from 4 to 8 to 13
   words; suffixes with equal prefixes of that length are dealt to the same group.
3. *Subtrees.* Each group sorts its suffixes along their path (4, 8, 13 words) and cuts them
   into nodes. A node of depth 13 with leaves of several documents is a repeat. Each bucket
   of documents sends a path once, with its smallest doc_id, so a passage in a third of all
   documents is one leaf per bucket. Back go the paths that have a smaller doc_id elsewhere.
4. *Removal.* The buckets mark the words of these windows and of windows that repeat inside
   the bucket.

Texts travel compressed. Buckets and groups hold about the same number of documents and
suffixes at every size of input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.groups import groups
from orderweave.llm.words import STEP_BYTES, Words, mixed, range_hashes, steps, words_of

DEPTH, ANCHOR, PREFIXES = 13, 6, (4, 8)
#: Documents per bucket, on average; as many groups of suffixes as buckets.
BUCKET_DOCS = 2000
#: Anchors that a task holds before it packs them.
HELD = 4_000_000
#: A prefix slot with more than so many times the mean windows of a group is lengthened.
OVERFULL = 0.5


def _prepared(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, doc_id, text. Rows without doc_id are spread by their text."""
    doc_id = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return docs.select(
        F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(buckets)).cast("int").alias("bucket"),
        doc_id.alias("doc_id"), text.alias("text"))


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each 13-word window, and the number of its first word."""
    return w.grams(DEPTH)


def _anchors(w: Words, at: np.ndarray) -> np.ndarray:
    """The anchor of each window that starts at a word of ``at``."""
    n = len(w.hashes)
    if not len(at):
        return np.zeros(0, np.uint64)
    every = np.arange(n - ANCHOR + 1)
    least = range_hashes(w.hashes, every, every + ANCHOR)
    for shift in (1, 2, 4):  # the least of 2, 4, 8 = DEPTH - ANCHOR + 1 runs
        least = np.minimum(least[:-shift], least[shift:])
    return least[at]


def _slots(prepared: DataFrame, slots: int) -> DataFrame:
    """level, slot, n: windows by slot of their prefix, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(PREFIXES), slots), np.int64)
        for part in steps(batches):
            w = words_of(part.column(0))
            _, at = _windows(w)
            for level, k in enumerate(PREFIXES):
                h = range_hashes(w.hashes, at, at + k)
                counts[level] += np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots)
        level, slot = np.nonzero(counts)
        for i in range(0, len(level), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(level[j].astype(np.int32)), pa.array(slot[j]), pa.array(counts[level[j], slot[j]])],
                                             names=["level", "slot", "n"])

    counted = prepared.select("text").mapInArrow(run, "level int, slot long, n long")
    return counted.groupBy("level", "slot").agg(F.sum("n").alias("n"))


def _pack_by(deal: np.ndarray, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows ordered by (deal, bucket), as one packed row for each of these pairs."""
    order = np.lexsort((bucket, deal))
    deal, bucket = deal[order], bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero((deal[1:] != deal[:-1]) | (bucket[1:] != bucket[:-1])) + 1 if len(deal) else []
    for s, e in zip([0, *cuts], [*cuts, len(deal)], strict=True):
        if e > s:
            yield int(deal[s]), int(bucket[s]), [c[s:e].tobytes() for c in columns]


def _anchors_of(prepared: DataFrame, buckets: int) -> DataFrame:
    """deal, bucket, anchors, several: distinct anchors of a bucket's documents in a task."""

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((bucket, anchor))
        anchor, bucket = anchor[order], bucket[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        several = (np.diff(np.append(first, len(anchor))) > 1).astype(np.uint8)  # each entry is another document
        anchor, bucket = anchor[first], bucket[first]
        deal = (anchor % np.uint64(buckets)).astype(np.int32)
        rows = list(_pack_by(deal, bucket, anchor, several))
        for i in range(0, len(rows), 1000):
            part = rows[i: i + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()),
                 pa.array([r[2][0] for r in part], pa.binary()), pa.array([r[2][1] for r in part], pa.binary())],
                names=["deal", "bucket", "anchors", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in steps(batches):
            w = words_of(part.column(1))
            _, at = _windows(w)
            anchor, doc = _anchors(w, at), w.doc[at]
            order = np.lexsort((anchor, doc))
            anchor, doc = anchor[order], doc[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            held.append((anchor[new], part.column(0).to_numpy()[doc[new]]))
            if sum(len(x) for x, _ in held) > HELD:
                yield from pack(held)
                held = []
        if held:
            yield from pack(held)

    return prepared.where("doc_id is not null").select("bucket", "text").mapInArrow(
        run, "deal int, bucket int, anchors binary, several binary")


def _repeated(anchors: DataFrame) -> DataFrame:
    """bucket, kind 0, doc_id null, blob: for each bucket its anchors that stand in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            blobs, flags = t.column(2).to_pylist(), t.column(3).to_pylist()
            bucket = np.repeat(t.column(1).to_numpy(), [len(b) // 8 for b in blobs])
            anchor = np.frombuffer(b"".join(blobs), np.uint64)
            several = np.frombuffer(b"".join(flags), np.uint8)
            order = np.argsort(anchor, kind="stable")
            anchor, bucket, several = anchor[order], bucket[order], several[order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(first, len(anchor)))
            shared = np.repeat((size > 1) | (np.maximum.reduceat(several, first) > 0), size)
            rows = list(_pack_by(np.zeros(int(shared.sum()), np.int32), bucket[shared], anchor[shared]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()),
                 pa.array([None] * len(rows), pa.int64()), pa.array([r[2][0] for r in rows], pa.binary())],
                names=["bucket", "kind", "doc_id", "blob"])

    return anchors.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "bucket int, kind int, doc_id long, blob binary")


def _packed(prepared: DataFrame) -> DataFrame:
    """bucket, kind 1, doc_id, blob (null for a null text): compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part in steps(batches, "text"):
            blobs = [None if t is None else pack.compress(t.encode()) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([1] * part.num_rows, pa.int32()), part.column(1), pa.array(blobs, pa.binary())],
                names=["bucket", "kind", "doc_id", "blob"])

    return prepared.mapInArrow(run, "bucket int, kind int, doc_id long, blob binary")


def _unpacked(t: pa.Table) -> Iterator[tuple[np.ndarray, list[int | None], pa.Array]]:
    """The documents of a bucket by steps: row numbers, doc_ids, texts."""
    unpack = zstandard.ZstdDecompressor()
    row = 0
    for b in t.select([2, 3]).to_batches():
        ids, texts, size = [], [], 0
        for doc_id, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(None if blob is None else unpack.decompress(blob))
            size += len(texts[-1] or b"")
            if size > STEP_BYTES:
                yield np.arange(row, row + len(ids)), ids, pa.array(texts, pa.large_binary())
                row, ids, texts, size = row + len(ids), [], [], 0
        if ids:
            yield np.arange(row, row + len(ids)), ids, pa.array(texts, pa.large_binary())
            row += len(ids)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _split(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The hashes sent to a bucket, sorted, and its documents."""
    kind = t.column(1).to_numpy()
    n = int(np.count_nonzero(kind == 0))
    blobs = t.column(3).slice(0, n).to_pylist()
    return np.sort(np.frombuffer(b"".join(blobs), np.uint64)), t.slice(n)


def _suffixes(bucketed: DataFrame, buckets: int, overfull: list[np.ndarray], slots: int) -> DataFrame:
    """deal, bucket, paths (4, 8 and 13 words), docs: each path of a bucket once, with its smallest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            bucket = t.column(0)[0].as_py()
            known, docs = _split(t)
            found = []
            for _, ids, texts in _unpacked(docs):
                w = words_of(texts)
                path, at = _windows(w)
                named = np.array([i is not None for i in ids], bool)
                doc = np.array([i or 0 for i in ids], np.int64)
                keep = _in(_anchors(w, at), known) & named[w.doc[at]]
                path, at = path[keep], at[keep]
                found.append((range_hashes(w.hashes, at, at + PREFIXES[0]), range_hashes(w.hashes, at, at + PREFIXES[1]),
                              path, doc[w.doc[at]]))
            if not found:
                continue
            four, eight, path, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, path))
            four, eight, path, doc = four[order], eight[order], path[order], doc[order]
            new = np.ones(len(path), bool)
            new[1:] = path[1:] != path[:-1]
            four, eight, path, doc = four[new], eight[new], path[new], doc[new]
            # The shortest prefix that is not too full for a group deals the suffix.
            prefix = path.copy()
            for level, h in ((1, eight), (0, four)):
                fits = ~_in(h % np.uint64(slots), overfull[level])
                prefix[fits] = h[fits]
            deal = (mixed(prefix) % np.uint64(buckets)).astype(np.int32)
            rows = list(_pack_by(deal, np.full(len(deal), bucket, np.int32), four.astype(np.uint32), eight.astype(np.uint32), path, doc))
            for i in range(0, len(rows), 1000):
                part = rows[i: i + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()),
                     *[pa.array([r[2][c] for r in part], pa.binary()) for c in range(4)]],
                    names=["deal", "bucket", "four", "eight", "path", "docs"])

    return bucketed.mapInArrow(run, "deal int, bucket int, four binary, eight binary, path binary, docs binary")


def subtree_nodes(four: np.ndarray, eight: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes along their path; the order, and where each node of depth 13 begins."""
    order = np.lexsort((path, eight, four))
    f, e, p = four[order], eight[order], path[order]
    # Neighbours part at depth 4, 8 or 13, or share a node of depth 13.
    parts = (f[1:] != f[:-1]) | (e[1:] != e[:-1]) | (p[1:] != p[:-1])
    return order, np.concatenate([[0], np.flatnonzero(parts) + 1])


def _marks(suffixes: DataFrame) -> DataFrame:
    """bucket, kind 0, doc_id null, blob: paths that stand in a document before all of the bucket's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            four, eight = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in (2, 3))
            path = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64)
            doc = np.frombuffer(b"".join(t.column(5).to_pylist()), np.int64)
            bucket = np.repeat(t.column(1).to_numpy(), [len(x) // 8 for x in t.column(4).to_pylist()])
            order, first = subtree_nodes(four, eight, path)
            doc, bucket, path = doc[order], bucket[order], path[order]
            least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
            later = doc > least
            rows = list(_pack_by(np.zeros(int(later.sum()), np.int32), bucket[later], path[later]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()),
                 pa.array([None] * len(rows), pa.int64()), pa.array([r[2][0] for r in rows], pa.binary())],
                names=["bucket", "kind", "doc_id", "blob"])

    return suffixes.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "bucket int, kind int, doc_id long, blob binary")


def _removed(bucketed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            earlier, docs = _split(t)
            if not docs.num_rows:
                continue
            # First the windows that repeat inside the bucket, then the words of each text.
            seen, ids = [], []
            for rows, doc_ids, texts in _unpacked(docs):
                path, at = _windows(w := words_of(texts))
                seen.append((path, rows[w.doc[at]]))
                ids += doc_ids
            path, row = (np.concatenate(x) for x in zip(*seen, strict=True))
            doc = np.array([0 if i is None else i for i in ids], np.int64)
            named = np.array([i is not None for i in ids], bool)
            hit = np.zeros(len(path), bool)
            mine = np.flatnonzero(named[row])
            if len(mine):
                order = mine[np.lexsort((doc[row[mine]], path[mine]))]
                p, d = path[order], doc[row[order]]
                first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
                hit[order] = (d > np.repeat(d[first], np.diff(np.append(first, len(p))))) | _in(p, earlier)
            done = 0
            for _, doc_ids, texts in _unpacked(docs):
                w = words_of(texts)
                _, at = _windows(w)
                at_hit = at[hit[done: done + len(at)]]
                done += len(at)
                marks = np.zeros(len(w.hashes) + 1, np.int32)
                np.add.at(marks, at_hit, 1)
                np.add.at(marks, at_hit + DEPTH, -1)
                gone = np.cumsum(marks)[:-1] > 0
                out, spans = [], []
                for i, text in enumerate(texts.to_pylist()):
                    mask = gone[w.first[i]: w.first[i + 1]]
                    words = (text or b"").split()  # bytes split at exactly the blanks of words.py
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans.append([{"first": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)])
                    out.append(b" ".join([x for x, g in zip(words, mask.tolist(), strict=True) if not g] if len(edges) else words))
                n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)),
                     pa.array(out, pa.binary()).cast(pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return bucketed.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first: bigint, words: bigint>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed (spans of words), per row of docs.

    docs: doc_id, text; other columns are not touched. A word goes if it is covered by a
    13-word window whose words also stand in a document with a smaller doc_id; windows are
    judged on the input. kept_text: the other words, joined by one space.

    Null or empty text, or no word: counts 0, kept_text empty. A row without doc_id is returned
    whole and makes nothing go. Rows that repeat a doc_id are the same document: none of them
    is earlier than the others. An empty table gives an empty result.
    """
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    prepared = _prepared(docs, buckets)
    slots = 1 << max(16, (4 * buckets - 1).bit_length())
    counted = _slots(prepared, slots)
    total = counted.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(1000, int(OVERFULL * total / buckets))
    # At most buckets / OVERFULL slots of each level are over the limit.
    full = counted.where(F.col("n") > limit).select("level", "slot").collect()
    overfull = [np.sort(np.array([r.slot for r in full if r.level == level], np.uint64)) for level in range(len(PREFIXES))]
    packed = _packed(prepared)
    together = lambda sent: sent.union(packed).repartition("bucket").sortWithinPartitions("bucket", "kind")
    repeated = _repeated(_anchors_of(prepared, buckets))
    suffixes = _suffixes(together(repeated), buckets, overfull, slots)
    return _removed(together(_marks(suffixes)))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from x),
f as (select g, min(doc_id) as first from g group by 1 having count(*) > 1),
gone as (select distinct doc_id, i + k as i from g join f using (g), range(13) as k(k) where doc_id > first),
w as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from d),
k as (select w.doc_id, string_agg(w, ' ' order by w.i) filter (where gone.i is null) as kept, count(gone.i) as n_removed
      from w left join gone on w.doc_id = gone.doc_id and w.i = gone.i group by 1)
select doc_id, len(d.w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
