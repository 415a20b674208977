"""A compressed full-text index over words: BWT in a wavelet matrix shaped by how often words occur, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with a count of ones every 64 bits, from the last of those kept every 1,024 bits: some 0.3 bits more a bit."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])
        self.far = before[::16].astype(np.int32)
        self.near = (before - np.repeat(before[::16], 16)[: len(before)]).astype(np.uint16)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, end: np.ndarray) -> np.ndarray:
        """How many ones stand before each end."""
        block = end >> 6
        mask = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.far[block >> 4] + self.near[block].astype(np.int64) + np.bitwise_count(self.words[block] & mask)


def shaped_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each symbol, first bit lowest, and its length: a symbol's share of 1 / 2**k or more gives it k bits.

    Symbols that end at a level take its largest codes (read with the last bit highest), so they stand at the end of what the level
    orders, and the levels below hold the others where they would stand without them.
    """
    share = np.maximum(counts, 1) / max(1, counts.sum())
    length = np.maximum(1, np.ceil(-np.log2(np.minimum(share, 1)) - 1e-9)).astype(np.int64)
    length[counts == 0] = 0
    code, free = np.zeros(len(counts), np.int64), np.zeros(1, np.int64)
    for level in range(int(length.max(initial=0))):
        free = np.concatenate([free, free + (1 << level)])
        own = np.flatnonzero(length == level + 1)
        code[own] = free[len(free) - len(own) :]
        free = free[: len(free) - len(own)]
    return code, length


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text in order, by doubling, and how many words each shares with the one before it (0 for the first).

    A suffix that ends is less than any that goes on.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    ranks, n = [rank.astype(np.int32)], len(text)
    while True:
        step = 1 << (len(ranks) - 1)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        both = rank * (n + 1) + ahead
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, np.diff(both[order]) != 0))[:n]
        if n == 0 or rank[order[-1]] == n:
            break
        ranks.append(rank.astype(np.int32))
    shared = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        one, two = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = np.maximum(one, two) < n
        same = inside & (ranks[k][np.where(inside, one, 0)] == ranks[k][np.where(inside, two, 0)])
        shared[1:] += same << k
    return order, shared


class Least:
    """The least of any run of values, from the least of each block's beginnings and ends and of 1, 2, 4, ... blocks: some four times the values' own bytes."""

    BLOCK = 16

    def __init__(self, values: np.ndarray) -> None:
        self.none = np.iinfo(values.dtype).max
        padded = np.full(-(-max(1, len(values)) // self.BLOCK) * self.BLOCK, self.none, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, self.BLOCK)
        self.values = padded
        self.up_to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.tables = [blocks.min(1)]
        while len(self.tables[-1]) > 1 << (len(self.tables) - 1):
            row, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(row[:-half], row[half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of the values from low on and before high, at least one of them."""
        first, last = low // self.BLOCK, (high - 1) // self.BLOCK
        out = np.minimum(self.onward[low], self.up_to[high - 1])
        inside = np.flatnonzero(first == last)
        at = low[inside][:, None] + np.arange(self.BLOCK)
        out[inside] = np.where(at < high[inside][:, None], self.values[np.minimum(at, len(self.values) - 1)], self.none).min(1)
        level = np.frexp((last - first - 1).astype(float))[1] - 1
        for k in np.unique(level[last - first > 1]).tolist():
            some = np.flatnonzero((level == k) & (last - first > 1))
            a, b = self.tables[k][first[some] + 1], self.tables[k][last[some] - (1 << k)]
            out[some] = np.minimum(out[some], np.minimum(a, b))
        return out


class Below:
    """The nearest value under a bound to either side of a place, by a tree of least values."""

    def __init__(self, values: np.ndarray) -> None:
        self.leaves = 1 << max(0, len(values) - 1).bit_length()
        self.tree = np.zeros(2 * self.leaves, np.min_scalar_type(int(values.max())))
        self.tree[self.leaves : self.leaves + len(values)] = values
        row = self.leaves
        while row > 1:
            self.tree[row // 2 : row] = self.tree[row : 2 * row].reshape(-1, 2).min(1)
            row //= 2

    def nearest(self, place: np.ndarray, bound: np.ndarray, right: bool) -> np.ndarray:
        """The place itself or the next one on that side whose value is under the bound; there must be one."""
        node = place + self.leaves
        on = np.flatnonzero(self.tree[node] >= bound)
        while len(on):
            edge = node[on] + right
            node[on] = edge // (edge & -edge) - (not right)
            on = on[self.tree[node[on]] >= bound[on]]
        on = np.flatnonzero(node < self.leaves)
        while len(on):
            near = 2 * node[on] + (not right)
            node[on] = np.where(self.tree[near] < bound[on], near, near ^ 1)
            on = on[node[on] < self.leaves]
        return node - self.leaves


class FMIndex:
    """Index over texts of word codes (1 and up; 0 parts the texts), each with an owner.

    An interval of suffixes answers at once whether a pattern occurs in a text of an owner
    below a given one, from the least owner over the interval. What neighbouring suffixes share
    widens an interval to that of the pattern's longest beginning which occurs elsewhere too.
    """

    def __init__(self, texts: np.ndarray, owners: np.ndarray, alphabet: int) -> None:
        order, shared = suffix_order(texts)
        bwt, self.size = texts[order - 1], len(texts)
        counts = np.bincount(texts, minlength=alphabet + 1)
        self.first = np.append(0, np.cumsum(counts))
        self.code, self.length = shaped_codes(counts)
        #: Where each symbol begins in the order of the level at which it ends.
        self.start, self.planes, now = np.zeros(alphabet + 1, np.int64), [], bwt
        for level in range(int(self.length.max(initial=0))):
            bit = (self.code[now] >> level & 1).astype(np.uint8)
            self.planes.append(Bits(bit))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
            left = int((self.length[now] > level + 1).sum())
            head = left + np.flatnonzero(np.diff(now[left:], prepend=-1))
            self.start[now[head]] = head
            now = now[:left]
        self.owners, rank = np.unique(owners, return_inverse=True)
        self.least = Least(rank[order].astype(np.min_scalar_type(len(self.owners))))
        self.shared = Below(np.append(shared, 0))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        begin = self.first[symbol] - self.start[symbol]
        ends = np.concatenate([low, high]).astype(np.int64)
        code, length = (np.concatenate([x[symbol], x[symbol]]) for x in (self.code, self.length))
        on = np.flatnonzero(length > 0)
        for level, plane in enumerate(self.planes):
            some = length[on] > level
            if not some.all():
                on = on[some]
            ones = plane.ones(at := ends[on])
            ends[on] = np.where(code[on] >> level & 1, plane.zeros + ones, at - ones)
        ends[length == 0] = 0  # a symbol that doesn't occur has an empty interval
        return ends[: len(low)] + begin, ends[len(low) :] + begin

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals, and the lengths of their patterns (0: all suffixes)."""
        tree, leaves = self.shared.tree, self.shared.leaves
        length = np.maximum(tree[low + leaves], tree[high + leaves]).astype(np.int64)
        some = np.flatnonzero(length)
        new_low, new_high = np.zeros(len(low), np.int64), np.full(len(low), self.size, np.int64)
        new_low[some] = self.shared.nearest(low[some], length[some], False)
        new_high[some] = self.shared.nearest(high[some], length[some], True)
        return new_low, new_high, length

    def matching(self, texts: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Matching statistics: for each place of texts, how many words from there on occur in a text of an owner below.

        Patterns texts[begin:end] with their owners are streamed together, each from its end
        backwards; symbols unknown to the index are -1. Where a word can't be put in front, the
        match is cut at its end, to the next larger interval, and tried again. Places outside
        the patterns have 0, and no match goes beyond its pattern.
        """
        out = np.zeros(len(texts), np.int32)
        own = np.searchsorted(self.owners, owner)
        on = (end > begin) & (own > 0)
        begin, place, own = begin[on], end[on].copy(), own[on]
        low, high = np.zeros(len(place), np.int64), np.full(len(place), self.size, np.int64)
        length = np.zeros(len(place), np.int64)
        while len(place):
            symbol = texts[place - 1]
            known = symbol >= 0
            new_low, new_high = self.extend(np.where(known, symbol, 0), low, high)
            some = np.flatnonzero(known & (new_high > new_low))
            some = some[self.least.over(new_low[some], new_high[some]) < own[some]]
            good = np.zeros(len(place), bool)
            good[some] = True
            length[some] += 1
            out[place[some] - 1] = length[some]
            skip = ~good & (~known | (length == 0))
            cut = np.flatnonzero(~good & ~skip)
            low[some], high[some] = new_low[some], new_high[some]
            low[skip], high[skip], length[skip] = 0, self.size, 0
            low[cut], high[cut], length[cut] = self.widen(low[cut], high[cut])
            place = place - (good | skip)
            on = place > begin
            if not on.all():
                begin, place, own, low, high, length = (x[on] for x in (begin, place, own, low, high, length))
        return out
