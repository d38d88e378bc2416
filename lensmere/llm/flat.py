"""Texts of an Arrow batch as one flat byte array: words, hashes and set operations on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about so many bytes; one longer text makes a group of its own.
GROUP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(17)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def groups(column: pa.Array | pa.ChunkedArray, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        own = offsets[first:last + 1]
        yield first, data[own[0]:own[-1]], own - own[0]
        first = last


def slices(batch: pa.RecordBatch, column: str, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about so many bytes in one column, so that only those become Python objects."""
    at = 0
    for first, _, offsets in groups(batch.column(column), most):
        yield batch.slice(first, len(offsets) - 1)
        at = first + len(offsets) - 1
    assert at == batch.num_rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    up, down = _powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets by row) of the runs of bytes other than ASCII white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``size`` lower-cased words, sorted within each row, and offsets.

    A row with fewer words has its whole sequence as the only run; a row without words has none.
    """
    low = _LOWER[data]
    starts, ends, rows = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = span_hashes(low, starts, ends)
    n = len(h)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        part = np.zeros(n, np.uint64)
        part[:n - k] = h[k:]
        whole = mix(whole * _BASE + part + np.uint64(k + 1))
    counts = np.diff(rows)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(runs, out=out[1:])
    values = np.empty(out[-1], np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        v = np.array([counts[i]], np.uint64)
        for x in h[rows[i]:rows[i + 1]]:
            v = mix(v * _BASE + x)
        values[out[i]] = v[0]
    full = np.flatnonzero(counts >= size)
    if len(full):
        at = np.repeat(rows[full] - out[full], runs[full])
        to = np.concatenate([np.arange(out[i], out[i + 1]) for i in full]) if len(full) < len(counts) else np.arange(out[-1])
        values[to] = whole[to + at]
    parts, kept = [], np.zeros(len(offsets), np.int64)
    for i in range(len(counts)):
        own = np.sort(values[out[i]:out[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        kept[i + 1] = kept[i] + len(own)
    return np.concatenate(parts) if parts else values, kept
