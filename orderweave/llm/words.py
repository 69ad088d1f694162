"""Words of whole Arrow batches of texts as 64-bit hashes, vectorised.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return (``[^\\x20\\x09-\\x0D]+``). Hashes do not depend on process, machine
or batch, so that tasks can compare them. A chance clash of two of ``n`` different values
has a probability of about ``n**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_ODD = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _ODD) -> np.ndarray:
    """Hashes of values[start:end], for many ranges in constant time each."""
    n = len(values)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """The words of some texts, in order."""

    data: np.ndarray      # bytes of all texts
    text_at: np.ndarray   # where each text starts in data; one more entry than texts
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte after each word
    hashes: np.ndarray    # of each word
    first: np.ndarray     # number of the first word of each text; one more entry than texts
    doc: np.ndarray       # number of the text of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words inside one text, and the number of its first word."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(n - k + 1)
        at = at[self.doc[: n - k + 1] == self.doc[k - 1:]]
        return range_hashes(self.hashes, at, at + k, _GRAM), at


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Split texts into words. lower: A-Z as a-z."""
    data, text_at = text_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins, n = ~blank, len(data)
    ends_at = begins.copy()
    inner = text_at[(text_at > 0) & (text_at < n)]
    # A word begins where the byte before is blank or belongs to another text.
    begins[1:] &= blank[:-1]
    begins[inner] = ~blank[inner]
    ends_at[:-1] &= blank[1:]
    ends_at[inner - 1] = ~blank[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_at) + 1
    hashes = range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)
    first = np.searchsorted(starts, text_at, side="left")
    doc = np.repeat(np.arange(len(text_at) - 1), np.diff(first))
    return Words(data, text_at, starts, ends, hashes, first, doc)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text",
          step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most so many bytes of text, or of a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())).fill_null(0)
        at = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + step_bytes, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end
