"""Words and word windows of Arrow text columns, as numpy arrays over the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text whose words are hashed at a time; a longer text is taken alone.
SLICE = 1 << 20
_MASK = (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's bounds in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most size bytes, or one row."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, side="right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more than rows)."""
    body = ~IS_SEPARATOR[data]
    start, end = body.copy(), body.copy()
    start[1:] &= ~body[:-1]
    end[:-1] &= ~body[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= body[edges]
    end[edges - 1] |= body[edges - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n of each; the longest tables so far are kept."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        out = []
        for base in (_ODD[which], pow(_ODD[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 2 * SLICE:  # tables for a single very long text aren't kept
            _tables[which] = have
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span: a polynomial over the ring of 64-bit numbers, then mixed."""
    p, inverse = powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(_ODD[2]))


def window_hashes(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of every run of width word hashes, rows not minded."""
    n = max(0, len(words) - width + 1)
    h, factor = np.zeros(n, np.uint64), 1
    for k in range(width):
        h += words[k : k + n] * np.uint64(factor)
        factor = factor * _ODD[which] & _MASK
    return mix(h)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte planes of them side by side, which compress well."""
    if not len(values):
        return b""
    d = np.concatenate([values[:1], np.diff(values)])
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).tobytes()


def unpack_sorted(blob: bytes, kind=np.uint32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each row."""
    data, bounds = raw(column)
    parts, firsts, n = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(bounds):
        lo = bounds[a]
        s, e, first = word_spans(data[lo : bounds[b]], bounds[a : b + 1] - lo)
        parts.append(span_hashes(data[lo : bounds[b]], s, e, 0))
        firsts.append(first[1:] + n)
        n += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(firsts)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and row of every run of width words within a row."""
    count = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[:-1]
    return np.arange(len(row)) - np.repeat(before, count) + np.repeat(first[:-1], count), row


def plain_words(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: its rows, the words joined by single blanks, each word's span there, words before each row."""
    data, bounds = raw(column)
    for a, b in slices(bounds):
        lo = bounds[a]
        part = data[lo : bounds[b]]
        s, e, first = word_spans(part, bounds[a : b + 1] - lo)
        if lower:
            part = LOWER[part]
        body = ~IS_SEPARATOR[part]
        # One separator byte stays behind each word, whichever it is; it becomes a blank.
        tail = e[e < len(part)]
        blank = np.zeros(len(part), bool)
        blank[tail] = IS_SEPARATOR[part[tail]]
        chosen = body | blank
        place = np.cumsum(chosen) - 1
        out = np.where(blank, np.uint8(32), part)[chosen]
        ends = place[e - 1] + 1 if len(e) else e
        yield a, b, out, place[s] if len(s) else s, ends, first
