"""Groups of rows out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Lists of the rows that share ``keys``; the rows must come sorted by them."""
    held: list[dict] = []
    last: tuple | None = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held
