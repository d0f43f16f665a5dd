"""What a Python worker keeps from task to task: one table of remembered things at a time, so that the operators of a
pipeline, which share workers, don't add up their memories."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow
from pyspark.sql import DataFrame

_HELD: dict[Hashable, Any] = {}


def release() -> None:
    """Forget everything."""
    _HELD.clear()
    trim()


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pyarrow.RecordBatch]], Iterator[pyarrow.RecordBatch]], schema: Any) -> DataFrame:
    """``mapInArrow`` with free memory given back. Columns that pass through stay Arrow arrays, so a long beside a null
    keeps all its digits."""
    return rows.mapInArrow(tidy(run), schema)


def parts(batches: Iterator[pyarrow.RecordBatch], rows: int) -> Iterator[pyarrow.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record(**columns: pyarrow.Array | tuple[list, str]) -> pyarrow.RecordBatch:
    """A batch of Arrow arrays, or of lists with the name of their type."""
    arrays = [c if isinstance(c, pyarrow.Array) else pyarrow.array(c[0], pyarrow.type_for_alias(c[1])) for c in columns.values()]
    return pyarrow.RecordBatch.from_arrays(arrays, list(columns))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task's batches, with free memory given back now and then, and at its end: idle workers stay for
    a while, and what their allocators keep counts against the executor."""

    def inner(batches: Iterator) -> Iterator:
        for i, out in enumerate(run(batches)):
            yield out
            if i % 4 == 3:
                give_back()
        trim()

    return inner


def trim() -> None:
    gc.collect()
    give_back()


def give_back() -> None:
    """Free memory of Arrow's pool and, where the C library can, of the heap goes back to the system."""
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing under this key; what was held before goes first."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
        trim()
    return _HELD[key]
