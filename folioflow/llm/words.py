"""Words of UTF-8 texts as 64-bit hashes, computed over whole Arrow buffers with NumPy.

A word is a run of bytes that are a digit, a letter a-z after lower-casing A-Z, or part of a
non-ASCII character.  Null texts count as empty.  No step keeps a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioflow.functions.batches import lean, lean_group, release

__all__ = ["lean", "lean_group", "release"]

BLOCK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the worker's life, short unless a text is long."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        table = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        table[0] = 1
        _powers[name] = have = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0), each of about `most` bytes and of whole texts."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and where each text's words begin among them."""
    inside = IN_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power_table("up", BASE, len(low))[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table("down", BASE_INVERSE, len(low) + 1)[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words begin; the last entry is their number)."""
    low = LOWER[data]
    starts, ends, at = spans(low, offsets)
    return hashes(low, starts, ends), at


def hash_of(text: str) -> np.ndarray:
    """The word hashes of one text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and where each text's runs begin."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(begins[-1]) + np.repeat(at[:-1] - begins[:-1], counts)
    out = words[first].copy()
    for k in range(1, n):
        out = out * BASE + words[first + k]
    return (mix(out) if n > 1 else out), begins
