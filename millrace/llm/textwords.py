"""Words of many texts at once: borders and 64-bit hashes of all words of an Arrow string array, in numpy.

A word is a maximal run of word bytes.  A-Z count as a-z.  All functions work
on slices of bounded size, so that memory does not follow the batch; a single
text longer than a slice is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, dtype=U), dtype=U)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWER = {"p": _powers(1 << 10)}


def word_table(separators: str) -> np.ndarray:
    """Which byte values belong to words. ``blank``: all but space and \\t-\\r. ``alnum``: digits, letters, and all of 0x80-0xFF."""
    t = np.ones(256, dtype=bool)
    if separators == "blank":
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif separators == "alnum":
        t[:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
        t[0x41:0x5B] = True
    else:
        raise ValueError(separators)
    return t


@dataclass
class Words:
    """Words of rows first..last of an array; word k of row r is at index ``bounds[r] + k``."""

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray  # rows + 1
    rows: np.ndarray  # of each word, counted from first

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.bounds[row] : self.bounds[row + 1]]


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    elif pa.types.is_string(texts.type):
        kind = np.int32
    else:
        raise TypeError(f"strings are needed, not {texts.type}")
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def words(texts: pa.Array, table: np.ndarray, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of all rows, in slices of about ``size`` bytes."""
    data, ends = string_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        last = min(last, len(texts))
        part = data[ends[first] : ends[last]]
        hashes, starts = word_hashes(part, ends[first : last + 1] - ends[first], table)
        bounds = np.searchsorted(starts, ends[first : last + 1] - ends[first])
        yield Words(first, last, hashes, bounds, np.repeat(np.arange(last - first), np.diff(bounds)))
        first = last


def word_hashes(part: np.ndarray, borders: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a run of bytes; no word crosses a border."""
    is_word = table[part]
    at = np.flatnonzero(is_word)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    opens = np.empty(len(at), dtype=bool)
    opens[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=opens[1:])
    inner = borders[(borders > 0) & (borders < len(part))]
    inner = inner[is_word[inner]]
    opens[np.searchsorted(at, inner)] = True
    firsts = np.flatnonzero(opens)
    length = np.diff(np.append(firsts, len(at)))
    if (longest := int(length.max())) > len(_POWER["p"]):
        _POWER["p"] = _powers(2 * longest)
    rel = np.arange(len(at)) - np.repeat(firsts, length)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[_LOWER[part[at]]] * _POWER["p"][rel], firsts)
        return mix(sums + length.astype(U)), at[firsts]


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the first word) of all runs of k words within a row."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(w.rows[:n] == w.rows[k - 1 :])
    return gram_hashes(w.hashes, k)[at], at


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, rows not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.full(n, U(k), dtype=U)
        for j in range(k):
            out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
        return mix(out)
