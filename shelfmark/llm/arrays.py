"""Arrow text columns as numpy arrays: byte buffers, words, hashes, ragged selections.

Used inside tasks.  A word is a run of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text that are hashed at once

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[_LOWER]  # of each byte, lower-cased


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    both = []
    for p in (base, inverse):
        powers = np.full(n, p, dtype=np.uint64)
        powers[0] = 1
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = _powers(max(n, PIECE + (64 << 10)))
    return _tables[0], _tables[1]


def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of rolling hashes and of its inverse, ``n`` at least."""
    return _power_tables(n)


_holder: list = []


def claim(owner: str, release=None) -> None:
    """What a reused worker remembers belongs to one operator at a time: the last one's caches go."""
    if _holder and _holder[0] != owner:
        if _holder[1]:
            _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed
        if trim:
            trim(0)
    _holder[:] = [owner, release]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)``: text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the texts of a string array begin and end, without a copy of them."""
    kind, buffer = np.int64 if pa.types.is_large_string(column.type) else np.int32, column.buffers()[1]
    if buffer is None:
        return np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(buffer, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    offsets = _offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _cuts(data: np.ndarray) -> list[int]:
    """Ends of pieces of about PIECE bytes, each at white space (a longer word makes a longer piece)."""
    ends, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            found = np.flatnonzero(_SPACE[data[end: end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end += 4096
        at = min(end, len(data))
        ends.append(at)
    return ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)`` of the words of each text; equal hashes mean equal words (64 bits)."""
    hashes, starts_at, start = [], [], 0
    borders = offsets[:-1]
    for end in _cuts(data):
        part = data[start:end]
        solid = ~_SPACE[part]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = borders[(borders >= start) & (borders < end)] - start
        begins[inner] |= solid[inner]
        inner = inner[inner > 0] - 1
        ends[inner] |= solid[inner]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(first):
            powers, inverses = _power_tables(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[part] * powers[: len(part)], out=sums[1:])
            hashes.append(mix((sums[last + 1] - sums[first]) * inverses[first] + (last - first).astype(np.uint64)))
            starts_at.append(first + start)
        start = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets)


def windows_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours; ``len(hashes) - n + 1`` values."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    count = len(hashes) - n + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total *= _BASE
        total += hashes[k: k + count]
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
