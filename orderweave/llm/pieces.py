"""SentencePiece encoding with the n best segmentations, and decoding.

The pieces that match a text form a lattice. A forward Viterbi pass gives the best score from
the start to every position. These scores are the exact rest cost of a backward search, so
an A-star search from the end that orders its hypotheses by score so far plus Viterbi score completes
the segmentations in order, the best first, and looks at no other.

No piece spans the place between a character and a following blank, or between a letter and a
following sign of some kinds. There a text falls into parts, and a long part (in a script without blanks) again at all places that no piece spans.
The n best of the whole combine the n best of its parts, which is exact because scores add.
Only the n - 1 parts whose second best costs least can differ from their best. That cost comes
from a Viterbi pass that keeps two scores. So each distinct part takes one pass, many of them at
once, and the search runs on the few parts that matter. Tasks remember the parts they have met,
up to a fixed number.

Ties: of equal segmentations of a part the one whose piece ids, read from the end, come
first; of equal combinations the one that departs from the best at earlier parts.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.words import steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Segmentations per text; parts that a task remembers.
N_BEST, REMEMBERED = 3, 150_000
#: Scores as whole numbers of this part, so that sums are exact.
UNIT = 1_000_000
#: Parts longer than this are split where no piece spans.
SPLIT = 64
#: Beyond this length the last met of equal hypotheses of a part is followed first.
LONG = 2_000
#: Bytes of text whose new parts are looked at together.
STEP_BYTES = 1 << 21
NEVER = 1 << 62

#: Stands for the blank sign itself where a text holds it, so that it becomes bytes and not a blank.
_SIGN = "\U0010FFFE"

Option = tuple[int, tuple[int, ...]]  # score, piece ids


class Vocabulary:
    """Pieces and scores of a SentencePiece model file; characters without a piece become bytes."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: Sequence[int], names: list[bytes]) -> None:
        self.pieces, self.byte_ids, self.names = pieces, byte_ids, names
        #: Pieces by character: each node holds the nodes of the next characters, and id and score of its piece.
        self.root: dict = {}
        for p, found in pieces.items():
            node = self.root
            for c in p[:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(p[-1], [{}, None])[1] = found
        #: Below all pieces but those that the model bars by an extreme score.
        self.byte_score = min((s for _, s in pieces.values() if s > -(10 ** 8) * UNIT), default=0) - 10 * UNIT
        # No piece has a blank behind another character: a text is cut there. Nor have they some signs
        # behind a letter or digit: there, too.
        follows = {(a, c) for p in pieces for a, c in zip(p[:-1], p[1:], strict=True)}
        after_word = {c for a, c in follows if a.isalnum()}
        signs = "".join(re.escape(c) for c in string.punctuation if c not in after_word)
        if any(c == BLANK and a != BLANK for a, c in follows):
            self.part = r"(?s).+"
        elif signs:
            # Line breaks and the like that stand in no piece are parts of their own.
            alone = "".join(re.escape(c) for c in map(chr, range(32)) if not any(c in p for p in pieces))
            run = f"[{signs}]+[^{BLANK}{signs}{alone}]*"
            self.part = rf"[{alone}]|(?=[^{alone}]){BLANK}*[{signs}]*[^{BLANK}{signs}{alone}]*(?:(?<![^\W_]){run})*"
        else:
            self.part = f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"

    @classmethod
    def of(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, names = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            names.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(BLANK, " ").encode())
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                names[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = (i, round(sp.get_score(i) * UNIT))
        return cls(pieces, byte_ids, names)

    def edges(self, text: str) -> list[tuple[int, int, int | tuple[int, ...], int]]:
        """The lattice, ordered by start: start, end, piece id (or ids of bytes), score."""
        out, root, end = [], self.root, len(text)
        add = out.append
        for i, c in enumerate(text):
            node, j = root.get(c), i + 1
            single = node is not None and node[1]
            while node is not None:
                if node[1]:
                    add((i, j, *node[1]))
                if j == end:
                    break
                node = node[0].get(text[j])
                j += 1
            if not single:
                add((i, i + 1, *self.bytes_of(c)))
        return out

    def bytes_of(self, c: str) -> tuple[tuple[int, ...], int]:
        """A character as the ids of its bytes, and their score."""
        data = (BLANK if c == _SIGN else c).encode()
        return tuple([self.byte_ids[b] for b in data]), self.byte_score * len(data)


def reversed_ids(ids: int | tuple[int, ...]) -> tuple[int, ...]:
    return (ids,) if isinstance(ids, int) else ids[::-1]


def viterbi(edges: list, end: int) -> tuple[list[int], list]:
    """The best score from the start to each position, and the edge that ends there; ties by ids from the end."""
    best, back = [-NEVER] * (end + 1), [None] * (end + 1)
    best[0] = 0
    for edge in edges:
        i, j, ids, s = edge
        s += best[i]
        if s > best[j]:
            best[j], back[j] = s, edge
        elif s == best[j] and reversed_ids(ids) < reversed_ids(back[j][2]):
            back[j] = edge
    return best, back


def flat(ids: list[int | tuple[int, ...]]) -> tuple[int, ...]:
    out: list[int] = []
    for x in ids:
        if isinstance(x, int):
            out.append(x)
        else:
            out += x
    return tuple(out)


def best_and_cost(v: Vocabulary, text: str) -> tuple[tuple[int, ...], int, int]:
    """The best segmentation, its score, and what the second best costs more (NEVER: there is none).

    One Viterbi pass that keeps the two best scores of each position and the last piece of the best.
    """
    end, root = len(text), v.root
    best, second = [-NEVER] * (end + 1), [-NEVER] * (end + 1)
    last: list = [None] * (end + 1)
    start = [0] * (end + 1)
    best[0] = 0
    for i, c in enumerate(text):
        one, two = best[i], second[i]
        node, j = root.get(c), i + 1
        if node is None or node[1] is None:
            data = v.bytes_of(c)
            score = one + data[1]
            if score > best[j]:
                second[j] = max(best[j], two + data[1])
                best[j], last[j], start[j] = score, data[0], i
            else:
                second[j] = max(second[j], score)
                if score == best[j] and data[0][::-1] < reversed_ids(last[j]):
                    last[j], start[j] = data[0], i
        while node is not None:
            found = node[1]
            if found is not None:
                piece, weight = found
                score = one + weight
                most = best[j]
                if score > most:
                    weight += two
                    second[j] = most if most > weight else weight
                    best[j] = score
                    last[j] = piece
                    start[j] = i
                elif score >= second[j]:
                    second[j] = score
                    if score == most and (piece,) < reversed_ids(last[j]):
                        last[j] = piece
                        start[j] = i
            if j == end:
                break
            node = node[0].get(text[j])
            j += 1
    ids, at = [], end
    while at:
        ids.append(last[at])
        at = start[at]
    # A second score below -NEVER / 2 comes from no path.
    return flat(ids[::-1]), best[end], NEVER if second[end] < -NEVER // 2 else best[end] - second[end]


class Passes:
    """The Viterbi pass of best_and_cost() for many parts at once, in arrays.

    Parts of equal length go together. The pieces that begin at a place are found by hashes of its
    character runs in sorted tables by length.
    """

    BASE, LIMIT = np.uint64(0x9E3779B97F4A7C15), 32

    def __init__(self, v: Vocabulary) -> None:
        by_length: dict[int, list[str]] = {}
        for p in v.pieces:
            by_length.setdefault(len(p), []).append(p)
        self.tables = []
        for length in range(1, min(max(by_length, default=0), self.LIMIT) + 1):
            texts = by_length.get(length, [])
            keys = self.runs(self.codes(texts, length), length)[:, 0] if texts else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            found = np.array([v.pieces[p] for p in texts], np.int64).reshape(-1, 2)[order]
            self.tables.append((keys[order], found[:, 0], found[:, 1]))

    @staticmethod
    def codes(texts: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64) + np.uint64(1)

    def runs(self, codes: np.ndarray, length: int, before: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of a length at each place; ``before``: those of one character less."""
        if before is None:
            before, done = np.zeros_like(codes), 0
        else:
            done = length - 1
        for k in range(done, length):
            before = before[:, : codes.shape[1] - k] + codes[:, k:] * self.BASE ** np.uint64(k + 1)
        return before

    def __call__(self, texts: list[str], length: int) -> tuple[np.ndarray, ...] | None:
        """As best_and_cost(), in arrays: ids of all parts in order, how many each has, score, cost, and
        whether they hold; they do not for a part with a character that is no piece."""
        n, codes, edges, runs = len(texts), self.codes(texts, length), [], None
        for k in range(1, min(length, len(self.tables)) + 1):
            runs = self.runs(codes, k, runs)
            keys, ids, weights = self.tables[k - 1]
            if not len(keys):
                edges.append(None)
                continue
            at = np.minimum(np.searchsorted(keys, runs.T), len(keys) - 1)
            hit = keys[at] == runs.T
            edges.append((hit.any(axis=1).tolist(), np.where(hit, weights[at], -NEVER // 2), ids[at]))
        if not edges or edges[0] is None:
            return None
        whole = (edges[0][1] > -NEVER // 2).all(axis=0)
        best, second = np.zeros((length + 1, n), np.int64), np.full((length + 1, n), -NEVER // 2)
        last, step = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64)
        for j in range(1, length + 1):
            top, two = np.full(n, -NEVER // 2), np.full(n, -NEVER // 2)
            for k in range(1, min(j, len(edges)) + 1):
                i = j - k
                if edges[k - 1] is None or not edges[k - 1][0][i]:
                    continue
                weight, piece = edges[k - 1][1][i], edges[k - 1][2][i]
                score = np.maximum(best[i] + weight, -NEVER // 2)
                better = score > top
                take = better | ((score == top) & (score > -NEVER // 2) & (piece < last[j]))
                two = np.where(better, np.maximum(top, second[i] + weight), np.maximum(two, score))
                top = np.maximum(top, score)
                last[j] = np.where(take, piece, last[j])
                step[j] = np.where(take, k, step[j])
            best[j], second[j] = top, np.maximum(two, -NEVER // 2)
        cost = np.where(second[length] > -NEVER // 4, best[length] - second[length], NEVER)
        rows, at, taken = np.arange(n), np.full(n, length), []
        while at.any():
            taken.append(np.where(at > 0, last[at, rows], -1))
            at = np.maximum(at - np.where(at > 0, np.maximum(step[at, rows], 1), 0), 0)
        paths = np.stack(taken[::-1], axis=1)
        there = paths >= 0
        return paths[there], there.sum(axis=1), best[length], cost, whole


def n_best(edges: list, end: int, n: int) -> list[Option]:
    """The n best paths through the lattice, the best first, by A-star from the end.

    A hypothesis is a path from a position to the end. It is opened with the best edge before it
    and, once taken, followed by the next best one in its place, so that few are ever held.
    """
    best, _ = viterbi(edges, end)
    keyed, ending = end <= LONG, {}

    def before(at: int) -> list:
        if at not in ending:
            ending[at] = sorted((e for e in edges if e[1] == at), key=lambda e: (-(best[e[0]] + e[3]), reversed_ids(e[2])))
        return ending[at]

    if not keyed:
        for e in edges:
            ending.setdefault(e[1], []).append(e)
        for at in ending:
            ending[at].sort(key=lambda e: (-(best[e[0]] + e[3]), reversed_ids(e[2])))
    met, out = 0, []
    heap: list[tuple] = []

    def push(at: int, nth: int, score: int, back: tuple, path) -> None:  # noqa: ANN001
        nonlocal met
        if nth < len(before(at)):
            e = before(at)[nth]
            met += 1
            heapq.heappush(heap, (-(score + e[3] + best[e[0]]), (*back, *reversed_ids(e[2])) if keyed else (), -met, e, nth, score, back, path))

    push(end, 0, 0, (), None)
    while heap and len(out) < n:
        _, own, _, e, nth, score, back, path = heapq.heappop(heap)
        push(e[1], nth + 1, score, back, path)
        mine = (e, path)
        if e[0]:
            push(e[0], 0, score + e[3], own, mine)
            continue
        taken = []
        while mine:
            taken.append(mine[0])
            mine = mine[1]
        out.append((score + e[3], flat([x[2] for x in taken])))
    return out


def combined(total: int, parts: dict[int, list[Option]], n: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The n best ways to take one option of each part: score, and (part, option) where not the first.

    total: the score with all first options; parts: those that can differ, by their place.
    """
    heap: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
    seen, out = {()}, []
    while heap and len(out) < n:
        cost, taken = heapq.heappop(heap)
        out.append((total - cost, taken[::-1]))
        now = dict(taken)
        for p, options in parts.items():
            rank = now.get(p, 0)
            if rank + 1 < len(options):
                more = sorted({**now, p: rank + 1}.items(), reverse=True)
                if tuple(more) not in seen:
                    seen.add(tuple(more))
                    heapq.heappush(heap, (cost + options[rank][0] - options[rank + 1][0], more))
    return out


class Encoder:
    """Encodes texts; keeps what it has found for parts, up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST) -> None:
        self.v, self.n = vocabulary, n
        self.forget()
        self.cut = re.compile(vocabulary.part)
        self.passes = Passes(vocabulary)

    def forget(self) -> None:
        #: The number of each known part, and by it: score, cost of the second best, and where its ids begin in
        #: ``ids`` (one more entry than parts).
        self.known: dict[str, int] = {}
        self.options: dict[str, list[Option]] = {}
        self.score, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def parts(self, text: str) -> list[str]:
        chunks = self.cut.findall(BLANK + text.replace(BLANK, _SIGN).replace(" ", BLANK))
        if max(map(len, chunks)) <= SPLIT:
            return chunks
        out = []
        for chunk in chunks:
            if len(chunk) <= SPLIT:
                out.append(chunk)
                continue
            last = reach = 0
            for i, j, _, _ in self.v.edges(chunk):
                if i > last and reach <= i:  # no piece that begins before i ends behind it
                    out.append(chunk[last:i])
                    last = i
                reach = max(reach, j)
            out.append(chunk[last:])
        return out

    def __call__(self, text: str) -> tuple[int, list[int], list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """score, ids; and further segmentations: score, changes (at, pieces left out, pieces put in)."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list:
        """Each text as by a call; parts that are new are looked at together."""
        ids, at, score, more = self.arrays(texts)
        return [(int(s), ids[a:b].tolist(), m) for s, a, b, m in zip(score, at[:-1], at[1:], more, strict=True)]

    def learn(self, new: set[str]) -> None:
        """Take up parts that are not known."""
        by_length: dict[int, list[str]] = {}
        for p in new:
            by_length.setdefault(len(p), []).append(p)
        ids, sizes, scores, costs = [self.ids], [np.zeros(0, np.int64)], [self.score], [self.cost]
        for length, group in by_length.items():
            found = self.passes(group, length) if length <= Passes.LIMIT else None
            ok = np.zeros(len(group), bool) if found is None else found[-1]
            if not ok.all():
                # Those without arrays go last.
                rest = [group[i] for i in np.flatnonzero(~ok).tolist()]
                group = [group[i] for i in np.flatnonzero(ok).tolist()] + rest
                one = [best_and_cost(self.v, p) for p in rest]
                own = (np.fromiter(chain.from_iterable([f[0] for f in one]), np.int64), np.array([len(f[0]) for f in one]),
                       np.array([f[1] for f in one], np.int64), np.array([f[2] for f in one], np.int64))
                if found is None:
                    found = own
                else:
                    whole = (found[0][np.repeat(ok, found[1])], *[x[ok] for x in found[1:4]])
                    found = tuple(np.concatenate(x) for x in zip(whole, own, strict=True))
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group)), strict=True))
            ids.append(found[0].astype(np.int32))
            sizes.append(found[1])
            scores.append(found[2])
            costs.append(found[3])
        self.ids, self.score, self.cost = np.concatenate(ids), np.concatenate(scores), np.concatenate(costs)
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.concatenate(sizes))])

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """ids of all texts in order, where those of each begin (one more entry than texts), scores, and further
        segmentations."""
        parts = [self.parts(t) if t else [] for t in texts]
        every = set().union(*parts)
        new = every.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = every
        if new:
            self.learn(new)
        first = np.cumsum([0, *map(len, parts)])
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(first[-1]))
        begins = self.begins[which]
        sizes = self.begins[which + 1] - begins
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begins - at[:-1], sizes) + np.arange(at[-1])]
        score = np.diff(np.concatenate([[0], np.cumsum(self.score[which])])[first])
        cost = self.cost[which]
        more = [self.further(p, cost[a:b], at[a: b + 1], int(s)) if p else [] for p, a, b, s in zip(
            parts, first[:-1].tolist(), first[1:].tolist(), score, strict=True)]
        return ids, at[first], score, more

    def further(self, parts: list[str], cost: np.ndarray, at: np.ndarray, total: int) -> list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]:
        """The segmentations of a text behind the best, from its known parts; at: where their ids begin."""
        # The n - 1 smallest costs, earlier parts first.
        near = np.flatnonzero(cost <= np.partition(cost, self.n - 2)[self.n - 2]) if 1 < self.n <= len(cost) else np.arange(len(cost))
        near = sorted(near[np.argsort(cost[near], kind="stable")][: self.n - 1].tolist())
        for i in near:
            if parts[i] not in self.options:
                self.options[parts[i]] = n_best(self.v.edges(parts[i]), len(parts[i]), self.n)
        ways = combined(total, {i: self.options[parts[i]] for i in near}, self.n)
        return [(score, [(int(at[p] - at[0]), int(at[p + 1] - at[p]), self.options[parts[p]][r][1]) for p, r in taken]) for score, taken in ways[1:]]


def decoded(names: list[bytes], ids: Sequence[int]) -> str:
    """The text of piece ids; the blank put before the first piece goes. Broken bytes become U+FFFD."""
    return b"".join(map(names.__getitem__, ids)).decode(errors="replace")[1:]


def changed(ids: Sequence[int], changes: Sequence[tuple[int, int, Sequence[int]]]) -> list[int]:
    """The piece ids of a further segmentation."""
    out = list(ids)
    for at, old, new in sorted(changes, reverse=True):
        out[at: at + old] = new
    return out


_CHANGES = "array<struct<score: bigint, changes: array<struct<at: int, old: int, new: array<int>>>>>"
_ARROW = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct(
    [("at", pa.int32()), ("old", pa.int32()), ("new", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, vocabulary: Vocabulary, *keep: str, n: int = N_BEST) -> DataFrame:
    """The columns ``keep``, ids, score, more and round_trip, per row of docs.

    ids: the best segmentation of the whole text. score: its sum, in millionths of the model's
    scores. more: the next best n - 1, or as many as there are, each as its score and what it
    replaces. round_trip: whether decoding the ids gives the text again.

    Null or empty text: no ids, score 0; round_trip true (a null text counts as empty). Every other
    text has at least the pieces of its bytes. Repeated rows: each its own result. An empty
    table gives an empty result. Extra columns are not touched.
    """
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, n)
        for part in steps(batches, step_bytes=STEP_BYTES):
            texts = [t or "" for t in part.column(len(keep)).to_pylist()]
            ids, at, score, further = encoder.arrays(texts)
            same = [decoded(vocabulary.names, ids[a:b].tolist()) == t for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            more = [[{"score": s, "changes": [{"at": a, "old": o, "new": new} for a, o, new in c]} for s, c in m] for m in further]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(len(keep))], ids, pa.array(score, pa.int64()),
                 pa.array(more, _ARROW), pa.array(same)], names=[*keep, "ids", "score", "more", "round_trip"])

    return kept.mapInArrow(run, ", ".join([*fields, "ids array<int>", "score bigint", f"more {_CHANGES}", "round_trip boolean"]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """The columns ``keep`` and the text of ``ids``. Null ids: null; ids outside the vocabulary: an error."""
    kept = encoded.select(*keep, F.col("ids").cast("array<int>").alias("ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else decoded(vocabulary.names, ids) for ids in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    return kept.mapInArrow(run, ", ".join([*fields, "text string"]))
