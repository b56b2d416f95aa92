"""Vectorised helpers on the UTF-8 bytes of an Arrow text column, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about so many bytes (one longer text is a run of its own).
RUN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x8F14E45FCEEA167B)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    a = a.fill_null("")
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], times the inverse power of i, the polynomial hash of bytes i to j."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, which never cross rows, and the number of words before each row (n + 1)."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~SPACE[data]
    begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    first, last = offsets[:-1], offsets[1:] - 1
    full = last >= first
    begin[first[full]] = word[1:-1][first[full]]
    end[last[full]] = word[1:-1][last[full]]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and the number of words before each row (n + 1)."""
    starts, ends, before = word_bounds(data, offsets)
    h = prefix_hash(LOWER[data])
    _, inv = powers(len(data) + 1)
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64)), before


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of width words; of the whole sequence if it is shorter; empty without words."""
    h, before = word_hashes(data, offsets)
    n = len(h)
    full = np.zeros(n, np.uint64)
    for k in range(width):
        full[: max(0, n - k)] += mix(h[k:] + np.uint64(k * 0x51ED270B + 1)) * np.uint64((_BASE * (2 * k + 1)) & _MASK)
    full = mix(full)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            with np.errstate(over="ignore"):
                v = np.uint64(b - a)
                for w in h[a:b]:
                    v = v * np.uint64(_BASE) + w
            out.append(mix(np.array([v], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
