"""Vectorised text helpers for use inside Arrow tasks: byte buffers, tokens and window hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the vectorised helpers; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, base: int = _ODD) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, 1 << 16), base, np.uint64)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        if len(have) <= (BATCH_BYTES + 4096):
            _powers[base] = have
    return have[:n]


def tidy() -> None:
    """Give memory that is free back to the system: workers live on, and the next stage may need it elsewhere."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidied(run: Callable) -> Callable:
    """A function over Arrow batches that tidies up after its last batch."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text (or one row) with the text's bytes and row offsets."""
    for batch in batches:
        buf, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def token_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and per row the index of its first token (n + 1 values)."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the given byte spans; ``fold`` lower-cases A-Z. Spans must be sorted by start."""
    return part_hashes(buf, starts, ends, [(starts, ends)], fold)[0]


def part_hashes(
    buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], fold: bool = True
) -> list[np.ndarray]:
    """Hashes of several parts (starts, ends) of each span, for instance its whole and its first bytes."""
    out = [np.empty(len(starts), np.uint64) for _ in parts]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BATCH_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        part = buf[lo:hi]
        value = (LOWER[part] if fold else part).astype(np.uint64)
        value += np.uint64(1)
        value *= powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        inverse = powers(len(part) + 1, _INVERSE)
        for h, (a, b) in zip(out, parts):
            s, e = a[i:j] - lo, b[i:j] - lo
            h[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` bytes of one buffer, in blocks of bounded size."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BATCH_BYTES):
        hi = min(n, lo + BATCH_BYTES)
        part = buf[lo : hi + width - 1].astype(np.uint64)
        part += np.uint64(1)
        part *= powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        h = total[width:] - total[: len(part) - width + 1]
        h *= powers(len(h), _INVERSE)
        out[lo:hi] = mix(h)
    return out


def sequence_hashes(items: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive items in each row; a row with fewer (but some) items gives one of all.

    Returns the hashes and, per row, the index of its first hash (n + 1 values).
    """
    counts = np.diff(first)
    n_out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=bounds[1:])
    row = np.repeat(np.arange(len(counts)), n_out)
    at = first[row] + (np.arange(bounds[-1]) - bounds[row])
    left = np.minimum(counts[row], width)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        take = left > k
        h = np.where(take, mix(h * np.uint64(_ODD) + items[np.minimum(at + k, max(len(items) - 1, 0))]) if len(items) else h, h)
    return h, bounds


def label_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the undirected pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
