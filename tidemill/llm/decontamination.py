"""Benchmark passages in documents: keys of random walks give candidates, edit distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import cgk
from tidemill.llm._spark import slices, stored, table
from tidemill.llm._words import ALNUM, LOWER, spans

#: Bytes of an item's piece at most, and at least; with pieces below the least, items are looked for in every document.
MOST_PIECE, LEAST_PIECE = 8, 3
#: Bytes or places of documents looked at in one step, and bytes of benchmark text looked for at once.
STEP, BLOCK_BYTES = 1 << 14, 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: One value for each length of a key, so that keys of different lengths seldom meet.
_TAGS = np.random.default_rng(4242).integers(0, 2**64, MOST_PIECE + 1, np.uint64)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words, one space between them and a zero byte behind each text's last: bytes, where each word begins, and texts' first words."""
    data = LOWER[data]
    begin, end, counts = spans(data, offsets, ALNUM)
    size, edge = end - begin, np.append(0, np.cumsum(counts))
    first = np.append(0, np.cumsum(size + 1))
    out = np.full(first[-1], 0x20, np.uint8)
    out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[ALNUM[data]]
    out[first[edge[1:][counts > 0]] - 1] = 0
    return out, first, edge


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    wide = np.append(text, np.zeros(MOST_PIECE, np.uint8)).astype(np.uint64)
    out = wide[: len(text)].copy()
    for k in range(1, MOST_PIECE):
        out |= wide[k : k + len(text)] << np.uint64(8 * k)
    return out


def _low(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _without(keys: np.ndarray, d: int) -> np.ndarray:
    """keys of some n bytes from each place on, to keys of as many with the byte at d left out of n + 1."""
    return (keys[:-1] & _low(d)) | (keys[1:] & ~_low(d))


def changes(x: np.ndarray) -> np.ndarray:
    """Places of x whose value isn't that of the place before."""
    return np.flatnonzero(np.append(x[:1] == x[:1], x[1:] != x[:-1]))


def may_hold(item: np.ndarray, text: np.ndarray, most: int) -> bool:
    """Whether text has enough of item's runs of three bytes; an edit spoils three of them at most."""
    if len(item) < 3 or len(text) < 3:
        return True
    a, b = ((x[:-2].astype(np.int64) << 16) | (x[1:-1].astype(np.int64) << 8) | x[2:] for x in (item, text))
    return int(np.isin(a, b).sum()) >= len(a) - 3 * most


def least_edits(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least edit distance of item to any part of text, and where that part ends; (most + 1, 0) if above most."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, symbol in enumerate(item.tolist(), 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != symbol))
        new[0] = i
        row = np.minimum.accumulate(new - places) + places
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def least_edits_of_stretches(masks: np.ndarray, row: np.ndarray, size: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least edit distance of each stretch of at most 64 bytes to any part of its window of text, all at once (after Myers).

    masks[row] has, for each byte, a bit for each place of the stretch that holds it.
    """
    out = np.empty(len(row), np.int64)
    order = np.argsort(low - high, kind="stable")
    for at in range(0, len(order), 4096):
        own = order[at : at + 4096]
        begin, length, mask = low[own], (high - low)[own], row[own] * 256
        top, one = (size[own] - 1).astype(np.uint64), np.uint64(1)
        up, down = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
        score, best, flat = size[own].copy(), size[own].copy(), masks.ravel()
        going = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right").tolist()
        for k, n in enumerate(going):
            if n < len(up):
                out[own[n : len(up)]] = best[n:]
                begin, mask, top, up, down, score, best = (x[:n] for x in (begin, mask, top, up, down, score, best))
            same = flat.take(mask + text.take(begin + k))
            turn = same | down
            over = (((same & up) + up) ^ up) | same
            more, less = down | ~(over | up), up & over
            score = score + (more >> top & one).astype(np.int64) - (less >> top & one).astype(np.int64)
            best = np.minimum(best, score)
            more, less = more << one, less << one
            up, down = less | ~(turn | more), more & turn
        out[own[: len(best)]] = best
    return out


def by_document(starts: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows cut at documents' ends (a window may span several), without those too short for their item: documents, items, begins, ends."""
    one = np.maximum(np.searchsorted(starts, begin, "right") - 1, 0)
    n = np.maximum(np.searchsorted(starts, np.minimum(end, starts[-1]), "left") - one, 0)
    doc = np.repeat(one - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, begin, end = np.repeat(item, n), np.repeat(begin, n), np.repeat(end, n)
    begin, end = np.maximum(begin, starts[doc]), np.minimum(end, starts[doc + 1] - 1)
    fits = end - begin >= least[item]
    return doc[fits], item[fits], begin[fits], end[fits]


def _piece_size(length: int, most: int) -> int:
    return min(MOST_PIECE, length // (most // 2 + 1))


class Pieces:
    """Pieces of items too short for walks, by which every passage within most edits is found.

    In a passage within most edits, an item's whole pieces, counted twice, and those with one edit come
    to twice its pieces less most, on diagonals that most edits can reach. A piece that is whole or has a changed byte
    leaves a key without one of its bytes, one that lost a byte is such a key itself, and one with a
    byte more is whole once that byte is left out.
    """

    def __init__(self, texts: list[np.ndarray], length: np.ndarray, most: np.ndarray, chosen: list[int]) -> None:
        self.length, self.most, self.need = length, most, np.ones(len(texts), np.int64)
        pieces: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i in chosen:
            size = _piece_size(int(length[i]), int(most[i]))
            at = np.arange(length[i] // size) * size
            self.need[i] = 2 * len(at) - most[i]
            pieces.setdefault(size, []).append((packed(texts[i])[at] & _low(size), np.full(len(at), i), at))
        self.sizes, keys, item, place = sorted(pieces), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, some in pieces.items():
            whole, who, at = (np.concatenate(x) for x in zip(*some, strict=True))
            cut = [(whole & _low(d)) | ((whole >> np.uint64(8)) & ~_low(d)) for d in range(size)]
            keys += [self._hash(whole, size), *(self._hash(c, size - 1) for c in cut)]
            item += [who] * (size + 1)
            place += [at] * (size + 1)
        keys, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.at = item[order], place[order]
        self.bits = np.uint64(max(10, (64 * len(self.keys)).bit_length()))
        self.seen = np.zeros(1 << int(self.bits), bool)
        self.seen[self.keys >> (np.uint64(64) - self.bits)] = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": np.packbits(self.seen)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, seen=np.unpackbits(state["seen"]).view(bool))

    @staticmethod
    def _hash(keys: np.ndarray, size: int) -> np.ndarray:
        return (keys ^ _TAGS[size]) * _ODD

    def _hits(self, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys, and the entries of the index that they meet."""
        keys = self._hash(keys, size)
        some = np.flatnonzero(self.seen.take((keys >> (np.uint64(64) - self.bits)).view(np.int64)))
        keys = keys[some]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        same = self.keys[at] == keys
        some, at = some[same], at[same]
        low, n = self.first[at], self.first[at + 1] - self.first[at]
        return np.repeat(some, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items, and begin and end of the windows of text that may hold the item; starts is where each document begins."""
        longest = int(self.length.max(initial=0))
        places, entries, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(text), STEP):
            eight = packed(text[low : low + STEP + 2 * MOST_PIECE])
            for size in self.sizes:
                less, full = eight & _low(size - 1), eight & _low(size)
                every = [(full, size), (less, size - 1), *((_without(less, d), size - 1) for d in range(1, size - 1)), *((_without(full, d), size) for d in range(1, size))]
                for k, (keys, n) in enumerate(every):
                    where, entry = self._hits(keys[:STEP], n)
                    places.append(where + low)
                    entries.append(entry)
                    parts.append(np.full(len(where), k > 0, np.int64))
        place, entry, part = np.concatenate(places), np.concatenate(entries), np.concatenate(parts)
        # diagonals of one passage span most edits, and one more on each side where a key begins a byte off
        item, at = self.item[entry], self.at[entry]
        width = self.most + 3
        start = place - at + longest
        rows, columns = 2 + (len(text) + longest) // int(width.min(initial=3)), longest + 1
        own_cell = item * rows + start // width[item]
        # a piece counts once in a cell, as whole if it is found whole
        key = np.sort((own_cell * columns + at) * 2 + part)
        key = key[changes(key // 2)]
        cell = key // (2 * columns)
        edge = changes(cell)
        cell, n = cell[edge], np.add.reduceat(2 - key % 2, edge) if len(edge) else np.zeros(0, np.int64)
        beside = cell[1:] == cell[:-1] + 1
        most = np.zeros(len(cell), np.int64)
        most[:-1] = beside * n[1:]
        most[1:] = np.maximum(most[1:], beside * n[:-1])
        cell = np.append(cell[n + most >= self.need[cell // rows]], np.iinfo(np.int64).max)
        own = np.flatnonzero(cell[np.searchsorted(cell, own_cell)] == own_cell)
        # in what is left, count within width diagonals from each hit on
        columns = len(text) + 2 * longest + 3 + int(self.most.max(initial=0))
        key = np.sort(((item[own] * columns + start[own]) * (longest + 1) + at[own]) * 2 + part[own])
        key = key[changes(key // 2)]
        total = np.append(0, np.cumsum(2 - key % 2))
        line = key // (2 * (longest + 1))
        item = line // columns
        stop = np.searchsorted(line, line + width[item], "left")
        line = line[total[stop] - total[: len(key)] >= self.need[item]]
        line = line[changes(line)]
        item, begin = line // columns, line % columns - longest
        reach = self.most[item] + 2
        begin, end = begin - reach, begin + self.length[item] + 2 * reach
        return by_document(starts, item, begin, end, self.length - self.most)


class Items:
    """Benchmark items' words, and keys of the walks that begin in them.

    An item's embedding is that of walks from each of its beginnings (a single walk over the whole item would lose
    step after a few edits). A window of the item's size must meet some number of its beginnings: the longest keys, and
    with them the largest number, that reach the recall wanted on passages with edit_share of random edits, by
    simulation. Items with too few beginnings for that are looked for by their pieces, with all_by_pieces all others too, those without room for any edit as they are.
    """

    def __init__(self, rows: list[tuple[int, str]], edit_share: float, recall: float, all_by_pieces: bool = False) -> None:
        raw = [(text or "").encode() for _, text in rows]
        data, first, edge = normal(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw], dtype=np.int64)))
        self.ids, self.size = [i for i, _ in rows], np.diff(edge)
        self.texts = [data[first[a] : max(first[a], first[b] - 1)] for a, b in zip(edge, edge[1:], strict=False)]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(edit_share * n) for n in self.length.tolist()], np.int64)
        self.plain = np.flatnonzero((self.length > 0) & (self.most == 0)).tolist()
        edited = np.flatnonzero(self.most > 0).tolist()
        begins = {i: cgk.starts(self.texts[i], first[edge[i] : edge[i + 1] + 1] - first[edge[i]]) for i in edited}
        met = cgk.shares_met([self.texts[i] for i in edited], edit_share).tolist() if edited and not all_by_pieces else []
        self.need, level = np.zeros(len(rows), np.int64), {}
        for i in [] if all_by_pieces else edited:
            for k, share in enumerate(met):
                # walks that surely end inside the item, all of which an exact copy meets
                whole = int((begins[i] + cgk.LEVELS[k] <= self.length[i]).sum())
                if count := min(whole, cgk.most_sure(len(begins[i]), share, recall)):
                    self.need[i], level[i] = count, k
        walked = sorted(level)
        short = sorted(set(edited) - set(walked))
        self.anywhere = [i for i in short if _piece_size(int(self.length[i]), int(self.most[i])) < LEAST_PIECE]
        own = sorted(set(short) - set(self.anywhere))
        self.pieces = Pieces(self.texts, self.length, self.most, own) if own else None
        keys, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        passed: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in cgk.LEVELS]
        own_level: dict[int, list[np.ndarray]] = {k: [] for k in level.values()}
        for i in walked:
            text = np.append(self.texts[i], np.zeros(cgk.STEPS + 1, np.uint8))
            for walk in range(cgk.WALKS):
                every = cgk.keys(text, begins[i], walk)
                key, _, last = every[level[i]]
                inside = last < self.length[i]
                keys.append(key[inside]), item.append(np.full(inside.sum(), i)), place.append(begins[i][inside])
                own_level[level[i]].append(key[inside])
                for k in range(level[i] + 1):
                    passed[k].append(every[k][0][inside])
        self.own = {k: cgk.Seen(np.concatenate(x)) for k, x in own_level.items()}
        self.walked, self.seen = walked, [cgk.Seen(np.concatenate(p)) for p in passed[: max(level.values(), default=-1) + 1]]
        self.seen += [cgk.Seen(np.zeros(0, np.uint64))] * (len(cgk.LEVELS) - len(self.seen))
        keys, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.at = item[order], place[order]
        self.masks: np.ndarray | None = None

    def candidates(self, text: np.ndarray, first: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items, and begin and end of the windows of text that may hold the item; first is where words begin, begins where documents do."""
        none = np.zeros(0, np.int64)
        parts = [self.pieces.candidates(text, begins)] if self.pieces else []
        if self.walked and len(text):
            longer = np.append(text, np.zeros(cgk.STEPS + 1, np.uint8))
            start, found = cgk.starts(text, first), []
            width, longest = self.most + 1, int(self.length.max())
            rows = 2 + (len(text) + longest) // int(width[self.walked].min())
            for low in range(0, len(start), STEP):
                for walk in range(cgk.WALKS):
                    every = cgk.keys(longer, start[low : low + STEP], walk, self.seen)
                    for level, own in self.own.items():
                        key, begin, _ = every[level]
                        some = own.places(key)
                        key, begin = key[some], begin[some]
                        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                        same = self.keys[at] == key
                        begin, at = begin[same], at[same]
                        head, n = self.first[at], self.first[at + 1] - self.first[at]
                        entry = np.repeat(head - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        item, at = self.item[entry], self.at[entry]
                        diagonal = np.repeat(begin, n) - at + self.length[item]
                        found.append((item * rows + diagonal // width[item]) * longest + at)
            # beginnings of an item met in a cell of diagonals, and with those of the next cell
            key = np.sort(np.concatenate(found))
            cell = key[changes(key)] // longest
            edge = changes(cell)
            cell, n = cell[edge], np.diff(np.append(edge, len(cell)))
            both = n.copy()
            both[:-1] += (cell[1:] == cell[:-1] + 1) * n[1:]
            cell = cell[both >= self.need[cell // rows]]
            item = cell // rows
            first_low = cell % rows * width[item] - self.length[item] - self.most[item]
            low, high = np.maximum(first_low, 0), np.minimum(first_low + self.length[item] + 2 * self.most[item] + 2 * width[item], len(text))
            kept = self._within_reach(text, item, first_low, 2 * self.most[item] + 2 * width[item])
            parts.append(by_document(begins, item[kept], low[kept], high[kept], self.length - self.most))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none)

    def _within_reach(self, text: np.ndarray, item: np.ndarray, low: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Windows in which the least edits of an item's stretches of 64 bytes, each wherever it fits best, come to no more than most.

        A window has the item's length and slack; a stretch is looked for as far from the window's begin as it is from the item's, and within the slack.
        """
        if self.masks is None:
            stretches = -(-self.length // 64)
            self.first_mask = np.append(0, np.cumsum(stretches))
            self.masks = np.zeros((self.first_mask[-1], 256), np.uint64)
            for i, own in enumerate(self.texts):
                at = np.arange(len(own))
                np.bitwise_or.at(self.masks, (self.first_mask[i] + at // 64, own), np.uint64(1) << (at % 64).astype(np.uint64))
        kept = np.arange(len(item))
        edits = np.zeros(len(item), np.int64)
        for k in range(int((-(-self.length[item] // 64)).max(initial=0))):
            some = np.flatnonzero(self.length[item[kept]] > 64 * k)
            own = kept[some]
            size = np.minimum(64, self.length[item[own]] - 64 * k)
            begin, end = (np.clip(x, 0, len(text)) for x in (low[own] + 64 * k, low[own] + 64 * k + size + slack[own]))
            edits[own] += least_edits_of_stretches(self.masks, self.first_mask[item[own]] + k, size, text, begin, end)
            kept = kept[edits[kept] <= self.most[item[kept]]]
        return kept


def leaks_in(text: np.ndarray, first: np.ndarray, edge: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each document and item that it holds: least edits, first word and end word."""
    starts = first[edge]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(d: int, i: int, edits: int, stop: int) -> None:
        if (d, i) not in found or edits < found[d, i][0]:
            last = int(np.searchsorted(first, max(stop - 1, starts[d]), "right")) - int(edge[d])
            found[d, i] = (edits, max(0, last - int(items.size[i])), last)

    raw = text.tobytes()
    for i in items.plain:
        wanted = items.texts[i].tobytes()
        place = raw.find(wanted)
        while place >= 0:
            d = int(np.searchsorted(starts, place, "right")) - 1
            keep(d, i, 0, place + len(wanted))
            place = raw.find(wanted, int(starts[d + 1]))
    doc, item, begin, end = items.candidates(text, first, starts)
    some = np.flatnonzero(np.diff(starts) > 0)
    for i in items.anywhere:
        doc, item = np.append(doc, some), np.append(item, np.full(len(some), i))
        begin, end = np.append(begin, starts[some]), np.append(end, starts[some + 1] - 1)
    order = np.lexsort([begin, item, doc])
    windows: list[list[int]] = []
    for d, i, a, b in zip(doc[order].tolist(), item[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
        if windows and windows[-1][:2] == [d, i] and a - windows[-1][2] <= items.length[i] // 2:
            windows[-1][3] = max(windows[-1][3], b)
        else:
            windows.append([d, i, a, b])
    for d, i, a, b in windows:
        if found.get((d, i), (1,))[0] == 0:
            continue
        wanted, most = items.texts[i], int(items.most[i])
        place = raw.find(wanted.tobytes(), a, b)
        if place >= 0:
            keep(d, i, 0, place + len(wanted))
        elif may_hold(wanted, text[a:b], most):
            edits, stop = least_edits(wanted, text[a:b], most)
            if edits <= most:
                keep(d, i, edits, a + stop)
    return found


def _find(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = leaks_in(*normal(part.data, part.offsets), items)
            ids = part.rows.column(part.rows.schema.get_field_index(id_col))
            rows = [(d, items.ids[item], *x, 1 - x[0] / len(items.texts[item])) for (d, item), x in found.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64())],
                names=[id_col, "item_id", "edits", "first_word", "end_word", "likeness"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id long, edits long, first_word long, end_word long, likeness double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", all_by_pieces: bool = False) -> DataFrame:
    """id_col, item_id, edits, first_word, end_word and likeness for each document that holds a benchmark item.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of bytes beyond ASCII. A document
    holds an item when some part of its words, one space between them, is within edit_share of
    the item's bytes in edits; likeness is 1 less that share. Of several places the best is given, of equally good ones the first.
    Candidates come from keys of random walks, enough of them to find a passage with edit_share of random edits with a
    chance of recall (one with less edits more surely, an exact copy always), or from pieces of short items, which miss nothing.
    Edits that aren't random, such as one every five bytes, may spoil all of a passage's keys; with all_by_pieces no passage within edit_share is missed,
    however its edits are spread, at about twice the time. Other columns of docs are left out.
    Items of no words are never found; null
    and empty texts hold none. Rows that repeat give their pairs as often. The benchmark is looked for
    in blocks of about BLOCK_BYTES, one scan of docs each.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).dropDuplicates(["id"]).orderBy("id").collect()
        part = _find(docs, Items([(r["id"], r["text"]) for r in own], edit_share, recall, all_by_pieces), id_col, text_col)
        found = part if found is None else found.union(part)
    return found


def remove_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item. Rows with a null id stay."""
    leaks = stored(find_leaks(docs, benchmark, edit_share, recall, id_col, text_col).select(id_col).distinct())
    return docs.join(leaks, id_col, "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
