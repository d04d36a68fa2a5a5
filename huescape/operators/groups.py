"""Groups of consecutive rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


#: Rows of small groups that are handed over at once, about.
TOGETHER = 1 << 16


def by_group(make: Callable[[pa.Table], pa.RecordBatch], *keys: str):
    """For mapInArrow: make(rows) of whole groups of rows with equal keys (integers), which must lie side by side: one
    large group, or several small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            begins = (np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist()
            if now is not None and tuple(group[0].tolist()) != now:
                begins.insert(0, 0)
            at = 0
            for cut in begins:
                if rows + cut - at >= TOGETHER:
                    held.append(batch.slice(at, cut - at))
                    yield make(pa.Table.from_batches(held).combine_chunks())
                    held, rows, at = [], 0, cut
            held.append(batch.slice(at))
            rows += batch.num_rows - at
            now = tuple(group[-1].tolist())
        if held:
            yield make(pa.Table.from_batches(held).combine_chunks())

    return run
