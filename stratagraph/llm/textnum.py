"""Vectorised words and hashes over the bytes of many texts at once.

A text's words, their 64-bit hashes and those of word shingles come out of whole-array steps, with no loop over words.
Word hash: sum of (byte + 1) * base ** position modulo 2 ** 64 over the word, from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def byte_table(keep, lower: bool = True) -> np.ndarray:
    """For each byte 0 if it separates words, else the byte, A-Z lower-cased."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if keep(b):
            out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return out


#: Letters, digits and everything beyond ASCII.
WORDS = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mapped bytes, word starts, word ends, first word of each text and the number of words at the end)."""
    mapped = table[data]
    inside = mapped != 0
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[offsets < n]
        first[edges] = inside[edges]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return mapped, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_sums(mapped: np.ndarray) -> np.ndarray:
    up, _ = powers(len(mapped) + 1)
    out = np.zeros(len(mapped) + 1, U64)
    np.add.accumulate((mapped.astype(U64) + U64(1)) * up[: len(mapped)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(mapped), starts, ends)


_STEP = U64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text and their number at the end), in order of position.

    A text of fewer than `size` words, but not none, has one shingle of all its words if `short`."""
    words = np.diff(first)
    count = np.maximum(words - size + 1, 0)
    total = len(hashes)
    rolled = np.zeros(max(total - size + 1, 0), U64)
    for j in range(size):
        rolled = rolled * _STEP + hashes[j : j + len(rolled)]
    rolled = mix(rolled)
    small = np.flatnonzero((words > 0) & (words < size)) if short else np.zeros(0, np.int64)
    count[small] = 1
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    out = np.empty(at[-1], U64)
    text = np.repeat(np.arange(len(count)), count)
    where = np.arange(at[-1]) - at[text] + first[:-1][text]
    long_enough = words[text] >= size
    out[long_enough] = rolled[where[long_enough]]
    for i in small:
        x = np.zeros(1, U64)
        for h in hashes[first[i] : first[i + 1]]:
            x = x * _STEP + h
        out[at[i]] = mix(x + U64(words[i]))[0]
    return out, at
