"""Texts of one Arrow batch as flat numpy arrays: bytes, words, hashes of any byte span.

Helpers for code that runs inside tasks; nothing here knows Spark. Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time, so that the arrays stay in the processor's cache.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n at least."""
    if len(_powers[0]) <= n:
        size = max(PIECE * 2, n + 1)
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash; one to one."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, offsets of the texts, and which are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    whole = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` bytes; a longer text comes alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` takes the hash of any span."""
    powers, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def sliding_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of one length."""
    n = len(sums) - length
    _, inverse = _power_tables(len(sums))
    return mix((sums[length:] - sums[:n]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte letters from U+00C0 to U+00DE."""
    low = _LOWER[data]
    low[1:] += 32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8)
    return low


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the first word of each text.

    `separator` names other bytes that end a word.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~separator[data]
    outside = np.ones(n + 1, bool)
    outside[1:] = ~inside
    starts = np.flatnonzero(inside & (outside[:-1] | edge[:-1]))
    outside[:-1] = ~inside
    outside[n] = True
    ends = np.flatnonzero(inside & (outside[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` hashes in a row (runs may cross texts)."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : k + n] * np.uint64(_BASE + 2 * k))
    return out


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each element the number of the text it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def trim() -> None:
    """Gives free memory back to the system: a Python worker lives on between stages, with all that it once took."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def trimmed(run: Callable) -> Callable:
    """Task code over batches that gives its memory back at the end."""

    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return over_batches


def trimmed_group(run: Callable) -> Callable:
    """Task code over one group, or one batch, that gives its memory back at the end."""

    def over_group(table):
        try:
            return run(table)
        finally:
            trim()

    return over_group
