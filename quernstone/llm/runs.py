"""Groups of sorted Arrow batches, one at a time, across batch borders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of successive rows that are equal in the first keys columns (which hold
    no nulls). Rows of the group that is still open are the only ones kept."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            same &= c[1:] == c[:-1]
        cuts = [0, *(np.flatnonzero(~same) + 1), batch.num_rows]
        if kept and all(kept[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys)):
            kept.append(batch.slice(0, cuts[1]))
            cuts = cuts[1:]
        if len(cuts) > 1:
            if kept:
                yield pa.Table.from_batches(kept)
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            kept = [batch.slice(cuts[-2], cuts[-1] - cuts[-2])]
    if kept:
        yield pa.Table.from_batches(kept)
