"""Groups of rows in the partitions of a sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[pa.Table]:
    """Cut rows sorted by their first ``width`` integer columns into one table per group.

    A group may span batches; only the group at hand is held.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(width)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        if rest and tuple(keys[0]) != last:
            yield pa.Table.from_batches(rest)
            rest = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            rest.append(b.slice(start, end - start))
            if end < b.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
        last = tuple(keys[-1])
    if rest:
        yield pa.Table.from_batches(rest)
