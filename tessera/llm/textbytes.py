"""Words of a whole Arrow batch at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a run of bytes other than ASCII white space. Word hashes are differences of one running
polynomial sum over the bytes (mod 2^64, each byte first mapped to a random 64-bit value), so
hashing costs a few vector operations a byte and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SCATTER = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_SCATTER_LOWER = _SCATTER.copy()
_SCATTER_LOWER[65:91] = _SCATTER[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_POWERS: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _BLOCK + 1)
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 2 * _BLOCK:
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive slices of the batches with at most `most` bytes of text each, or one row."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one more entry than rows)."""
    blank = _BLANK[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.empty_like(blank), np.empty_like(blank)
    if len(blank):
        before[1:], after[:-1] = blank[:-1], blank[1:]
        before[0] = after[-1] = True
        before[inner] = after[inner - 1] = True
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(after & ~blank) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words; with lower, A-Z count as a-z."""
    table = _SCATTER_LOWER if lower else _SCATTER
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        stop = ends[to - 1]
        up, down = power_tables(int(stop - begin) + 1)
        sums = np.zeros(stop - begin + 1, dtype=np.uint64)
        np.cumsum(table[data[begin:stop]] * up[: stop - begin], out=sums[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A row with some words but fewer than size has one shingle, all its words; one without words
    has none.
    """
    count = len(hashes)
    rolled = hashes.copy()
    for j in range(1, min(size, count)):
        rolled[: count - j] = mix(rolled[: count - j]) + hashes[j:]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for i in range(a, b):
                whole = mix(whole) + hashes[i : i + 1]
            sets.append(mix(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
