"""Random walks over bytes that map edit distance to Hamming distance (after Chakraborty, Goldenberg and Koucky), and keys that sample their steps."""

from __future__ import annotations

import math

import numpy as np

#: Walks, their steps, and the numbers of steps behind which a walk gives a key of those it has sampled so far.
WALKS, STEPS, LEVELS = 8, 36, (12, 16, 20, 24, 28, 32, 36)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(1907)
#: For each walk and step, whether a byte lets the walk go on to the next byte.
_GO = _rng.integers(0, 2, (WALKS, STEPS, 256))
#: Sampled steps: the first, and half of all.
_READ = np.array([np.append(True, _rng.permutation(np.arange(STEPS - 1) % 2 == 0)) for _ in range(WALKS)])


def starts(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where walks begin: at each word, each character of three bytes and more, and in words of over 16 bytes at a quarter of all places, by what stands there."""
    begin = np.zeros(len(text), bool)
    begin[first[:-1]] = True
    begin |= text >= 0xE0
    size = np.diff(first) - 1
    for k in np.flatnonzero(size > 16).tolist():
        word = text[first[k] : first[k] + size[k]].astype(np.int64)
        begin[first[k] + 1 + np.flatnonzero((word[:-1] * 31 + word[1:] * 17) % 4 == 0)] = True
    return np.flatnonzero(begin)


class Seen:
    """A set of keys by their high bits: no key that was put in is missed, few others pass."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(10, (32 * len(keys)).bit_length()))
        self.flags = np.zeros(1 << (64 - int(self.shift)), bool)
        self.flags[keys >> self.shift] = True

    def __getstate__(self) -> tuple[np.uint64, np.ndarray]:
        """A bit a flag, as each Python worker holds what it was sent besides the set made of it."""
        return self.shift, np.packbits(self.flags)

    def __setstate__(self, state: tuple[np.uint64, np.ndarray]) -> None:
        self.shift, self.flags = state[0], np.unpackbits(state[1]).view(bool)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.flags.take((keys >> self.shift).view(np.int64)))


def keys(text: np.ndarray, begin: np.ndarray, walk: int, seen: list[Seen] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the keys of a walk from each place of text, those places, and the last ones the walk came to.

    text must go on for STEPS bytes. With seen (a set of each level's keys), a walk ends where its key isn't in the set.
    """
    at, key, out = begin.copy(), np.full(len(begin), walk, np.uint64), []
    byte, go, mixed = np.empty(len(begin), np.uint8), np.empty(len(begin), np.int64), np.empty(len(begin), np.uint64)
    for step in range(STEPS):
        np.take(text, at, out=byte, mode="clip")
        if _READ[walk, step]:
            key *= _ODD
            key += byte
            np.right_shift(key, np.uint64(29), out=mixed)
            key ^= mixed
        np.take(_GO[walk, step], byte, out=go, mode="clip")
        if step + 1 in LEVELS:
            made = (key ^ np.uint64(step)) * _ODD
            if seen is not None:
                some = seen[len(out)].places(made)
                made, begin, at, key, go, byte, mixed = (x[some] for x in (made, begin, at, key, go, byte, mixed))
            out.append((made, begin, at.copy()))
        at += go
    return out


def shares_met(texts: list[np.ndarray], edit_share: float, trials: int = 200) -> np.ndarray:
    """For each level, the share of an item's beginnings of which a copy with edit_share of random edits has a key of some walk too; of many items some from everywhere among them are tried."""
    rng, met, every = np.random.default_rng(3), np.zeros(len(LEVELS)), 0
    for trial in range(trials):
        item = texts[trial * len(texts) // trials if len(texts) > trials else trial % len(texts)]
        copy = item.tolist()
        for _ in range(int(edit_share * len(item))):
            at, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 3))
            new = int(item[rng.integers(0, len(item))])
            copy[at : at + (kind < 2)] = [new] if kind else []
            copy = copy or [new]
        sides = []
        for text in (item, np.array(copy, np.uint8)):
            first = np.append(np.flatnonzero(np.append(True, text[:-1] == 0x20)), len(text) + 1)
            sides.append((np.append(text, np.zeros(STEPS + 1, np.uint8)), starts(text, first), len(text)))
        (own, begin, size), (other, there, _) = sides
        hit = np.zeros((len(LEVELS), len(begin)), bool)
        for walk in range(WALKS):
            for level, ((key, _, last), (others, _, _)) in enumerate(zip(keys(own, begin, walk), keys(other, there, walk), strict=True)):
                hit[level] |= np.isin(key, others) & (last < size)
        met += hit.sum(1)
        every += len(begin)
    return met / max(every, 1)


def most_sure(n: int, share: float, recall: float) -> int:
    """The largest count that, of n beginnings met with a chance of share each, are met with a chance of recall; 0 if not even one is."""
    left, count = 1.0, 0
    while count < n:
        left -= math.comb(n, count) * share**count * (1 - share) ** (n - count)
        if left < recall:
            return count
        count += 1
    return count
