"""Words and word hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Bytes that belong to a word, by kind of word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a public finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in data, and how many words each text has. No word crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, offsets))


def totals(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch of data follows."""
    up, _ = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total


def stretch_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(total))
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes on every machine."""
    return stretch_hashes(totals(data), begin, end)


def grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place on, for the places whose n words lie in one text: hashes, places."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    places = np.flatnonzero(text[: len(words) - n + 1] == text[n - 1 :])
    total = words[places] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(1, n):
        total = mix(total + words[places + k] * np.uint64(2 * k + 1))
    return total, places
