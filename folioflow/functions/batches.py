"""Arrow batches in small parts, and memory that goes back.

Spark's batches have up to 10,000 rows or 64 MB, and what NumPy makes of one is many times that.  Code that works on parts of a
bounded size needs the same memory for full batches as for small ones."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and entries of lists, about, that a task works on at a time.
TEXT_BYTES, LIST_ENTRIES = 1 << 20, 1 << 17


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give blocks over 8 MB back as soon as they are freed; None where it is another one."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)
        libc.malloc_trim
        return libc
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Memory that is free goes back to the system: the worker lives on, and another one may need it."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, releasing memory at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc()
        yield from run(batches)
        release()

    return wrapped


def lean_group(work: Callable) -> Callable:
    """work, for applyInArrow, releasing memory after each group."""

    def one(table: pa.Table) -> pa.Table:
        _libc()
        out = work(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        _libc()
        out = work(left, right)
        release()
        return out

    return two if work.__code__.co_argcount == 2 else one


def spans(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first row, end row) of parts of a text or list column of about `most` bytes or entries; a row is never cut."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    size = pc.fill_null((pc.binary_length if text else pc.list_value_length)(column), 0).to_numpy(zero_copy_only=False)
    most = most or (TEXT_BYTES if text else LIST_ENTRIES)
    ends = np.cumsum(size.astype(np.int64) + 1)
    row, before = 0, 0
    while row < len(ends):
        end = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
        yield row, end
        row, before = end, int(ends[end - 1])


def split_tokens(joined: pa.Array) -> pa.Array:
    """The tokens of texts with a space between them; an empty text has none."""
    found = pc.split_pattern(joined, " ")
    flat, n = pc.list_flatten(found), pc.list_value_length(found).to_numpy()
    bare = pc.equal(pc.binary_length(joined), 0).to_numpy(zero_copy_only=False)
    if bare.any():
        flat, n = flat.filter(pc.greater(pc.binary_length(flat), 0)), np.where(bare, 0, n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes or entries of a column.  Memory goes back after each batch."""
    _libc()
    for batch in batches:
        for row, end in spans(batch.column(column), most):
            yield batch.slice(row, end - row)
        del batch
        release()
