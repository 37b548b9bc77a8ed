"""Words, shingles and their 64-bit hashes from the bytes of an Arrow text column, with numpy.

Everything works on whole texts: a batch is cut into pieces of whole documents of about ``PIECE`` bytes,
so memory is bounded by that and by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1_000_000
U = np.uint64
_BASE, _INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: A-Z to a-z; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters, digits and all beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
NEWLINE = 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * _BASE + U(salt))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            steps = np.full(max(n, 2 * len(_powers[i]), 1 << 16), b, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    raw, off = strings(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """Words of a run of texts: hash, first byte, byte after the last, text number; ``first``: n + 1 word offsets."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: bool = True) -> Words:
    """Maximal runs of bytes of ``kind`` (``fold``: in lower-cased text), never across texts."""
    n = len(off) - 1
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, z, np.zeros(n + 1, np.int64))
    low = LOWER[raw] if fold else raw
    inside = kind[low]
    at = np.zeros(len(raw) + 1, bool)
    at[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | at[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | at[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start]) if len(start) else np.zeros(0, U)
    first = np.searchsorted(start, off).astype(np.int64)
    return Words(h, start, end, np.repeat(np.arange(n), np.diff(first)), first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``k`` words; a text of fewer words, but not none, is one shingle."""
    count = np.diff(w.first)
    many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), many)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(len(text)) - first[text] + w.first[text]
    mul = seeds(k, k)
    h = np.zeros(len(text), U)
    padded = np.concatenate([w.hash, np.zeros(k, U)])
    last = w.first[text + 1]
    for i in range(k):
        h += np.where(at + i < last, padded[at + i], U(0)) * mul[i]
    return mix(h), text


def run_hash(h: np.ndarray):
    """A function of (starts, length): the hash of the run of ``length`` words from each start, wherever it stands."""
    up, down = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])

    def of(start: np.ndarray, length: int) -> np.ndarray:
        return mix((total[start + length] - total[start]) * down[start])

    return of


def shingle_starts(w: Words, k: int) -> np.ndarray:
    """Word number at which each shingle of ``shingles`` starts."""
    count = np.diff(w.first)
    many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(count)), many)
    return np.arange(len(text)) - first[text] + w.first[text]


def distinct(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one text after another, and their n + 1 offsets."""
    first = np.searchsorted(text, np.arange(n + 1))
    parts = [np.unique(h[first[i] : first[i + 1]]) for i in range(n)]
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Wrapping sums of the ranges between offsets."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
