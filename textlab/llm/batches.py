"""Small helpers for functions that run inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows taken out of an Arrow batch at a time, so that a task holds few texts as Python objects.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a task, a few hundred at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def worker_state(name: str, make):
    """An object that lives as long as the Python worker, whichever task runs in it."""
    import sys
    import types

    holder = sys.modules.setdefault("_textlab_worker_state", types.ModuleType("_textlab_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
