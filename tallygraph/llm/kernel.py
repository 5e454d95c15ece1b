"""Bytes of Arrow string columns as numpy arrays: word boundaries and word hashes of a whole batch without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a text longer than this is handled in pieces that end between words.
PIECE = 1 << 21

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of splitmix64), a different one for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_LETTER = mix64(np.arange(256, dtype=np.uint64), 1)
_FOLDED = _LETTER[FOLD]
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes that split no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + PIECE)
        while b < n:
            near = SEPARATOR[data[b : b + 4096]]
            k = int(near.argmax()) if near.any() else len(near)
            edge = int(np.searchsorted(offsets, b))
            if edge < len(offsets) and offsets[edge] <= b + k:
                b = int(offsets[edge])
                break
            b += k
            if near.any():
                break
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): the words of all texts in order; text i has the words first[i] to first[i + 1]."""
    hashes, starts, ends = [], [], []
    letters = _FOLDED if fold else _LETTER
    for a, b in _pieces(data, offsets):
        part = data[a:b]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(SEPARATOR[part], out=inside[1:-1])
        begins = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a  # a text ends a word
        begins[edges] = inside[1:-1][edges]
        edges = edges[edges > 0] - 1
        stops[edges] = inside[1:-1][edges]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(s):
            continue
        size = e - s
        total = int(size.sum())
        ends_at = np.cumsum(size)
        within = np.arange(total) - np.repeat(ends_at - size, size)
        chars = part if total == len(part) else part[inside[1:-1]]
        with np.errstate(over="ignore"):
            value = letters[chars] * (_POWER[within & 0xFFF] + (within >> 12).astype(np.uint64))
            h = np.add.reduceat(value, ends_at - size)
            hashes.append(mix64(h + size.astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), at, np.concatenate(ends), np.searchsorted(at, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of the whole sequence when there are fewer (none without words)."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = total * np.uint64(0xD1342543DE82EF95) + hashes[k : k + n]
    return mix64(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]
