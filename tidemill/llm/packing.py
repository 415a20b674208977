"""Packing documents into training sequences by first-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import slices, table
from tidemill.llm._words import NOT_SPACE, hashes, spans

#: How the tokenizer cuts lower-cased text between white space (fixed values of its file).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids by white-space word, remembered for the words met of late.

    The tokenizer drops white space and never joins across it, so a text's ids are
    its words' ids in a row. Words of printable ASCII and Latin letters are first cut into
    the tokenizer's own pieces, which repeat more often than words do, and encoded many at once;
    all other words, and those that may hold a special token, are encoded by themselves. Words are found
    by a 64-bit hash with their length and first bytes; each has two slots in a table of
    fixed size, and all are forgotten when `keep` ids are held.
    """

    SLOTS = 20

    def __init__(self, path: str, keep: int = 3_000_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.find = keep, regex.compile(PIECE_PATTERN).findall
        latin = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c != "\u0130")
        self.plain = regex.compile(rf"[!-~{latin}]+").fullmatch
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        n = 1 << self.SLOTS
        self.keys, self.heads = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.sizes, self.at, self.n = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces as the tokenizer cuts them: each has ids, of which the last alone ends a word."""
        out = {}
        for low in range(0, len(pieces), 2048):
            some = pieces[low : low + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            out.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        return out

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        every = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, every, strict=True)}

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a word, or None where it must be encoded by itself."""
        if not self.plain(text) or "<|" in text:
            return None
        text = text.lower()
        return [text] if text.isalpha() else self.find(text)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Add the ids of new words to what is held: where each word's begin, and how many they are."""
        texts = [word.decode() for word in words]
        cut = [self._cut(text) for text in texts]
        get = self._encode_pieces(list({p for parts in cut for p in parts or ()})).__getitem__
        odd = self._encode_words([t for t, parts in zip(texts, cut, strict=True) if parts is None])
        ids = [odd[t] if parts is None else b"".join(map(get, parts)) for t, parts in zip(texts, cut, strict=True)]
        n = np.array([len(x) // 4 for x in ids], np.int64)
        new = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(new) > len(self.flat):
            self.flat = np.append(self.flat[: self.used], np.zeros(self.used + 2 * len(new), np.uint32))
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        return at, n

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and the last's end."""
        if self.used > self.keep:
            self._forget()
        begin, end, counts = spans(data, offsets, NOT_SPACE)
        hashed, size = hashes(data, begin, end), (end - begin).astype(np.int32)
        head = np.zeros(len(begin), np.uint32)
        for k in range(4):
            head = head << np.uint32(8) | np.where(size > k, data[np.minimum(begin + k, len(data) - 1)], 0).astype(np.uint32)
        slot = (hashed >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        other = (hashed & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)
        slot = np.where(self.keys[slot] == hashed, slot, other)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != hashed) | (self.sizes[slot] != size) | (self.heads[slot] != head))
        if len(miss):
            _, first, which = np.unique(hashed[miss], return_index=True, return_inverse=True)
            one = miss[first]
            new_at, new_n = self._learn([data[a:b].tobytes() for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            at[miss], n[miss] = new_at[which], new_n[which]
            place = (hashed[one] >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            place = np.where(self.keys[place] == 0, place, (hashed[one] & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64))
            place, last = np.unique(place[::-1], return_index=True)
            last = len(one) - 1 - last
            for column, values in ((self.keys, hashed[one]), (self.heads, head[one]), (self.sizes, size[one]), (self.at, new_at), (self.n, new_n)):
                column[place] = values[last]
        held = np.cumsum(n)
        flat = self.flat[np.repeat(at - (held - n), n) + np.arange(held[-1] if len(held) else 0)]
        return flat, np.append(0, held)[np.append(0, np.cumsum(counts))]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    """One for each Python worker, so that words stay known from task to task."""
    return WordIds(path)


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, most: int = 2048, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token ids with end_id after them, cut into pieces of at most `most` ids.

    Columns: id_col, start, length, ids_crc32, doc_tokens, ids on request, and row (the document's place in
    the table; not where id_col has that name). Special tokens in a text get their ids, as the tokenizer's file has it.
    Null and empty texts give one piece that holds end_id alone. Rows that repeat
    give their pieces as often. Other columns of docs are left out.
    """
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = {id_col: id_type, "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"} | ({"ids": "array<int>"} if keep_ids else {}) | ({"row": "long"} if id_col != "row" else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _word_ids(path)
        for part in slices(batches, text_col):
            flat, edge = book.ids(part.data, part.offsets)
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)):
                own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for low in range(0, len(own), most):
                    piece = own[low : low + most]
                    row.append(k), start.append(low), length.append(len(piece)), total.append(len(own))
                    crc.append(zlib.crc32(piece.tobytes()))
                    if keep_ids:
                        ids.append(piece.astype(np.int32))
            at = pa.array(row, pa.int64())
            out = [part.rows.column(0).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            out += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
            out += [part.rows.column(2).take(at)] * ("row" in kinds)
            yield pa.RecordBatch.from_arrays(out[: len(kinds)], names=list(kinds))

    plain = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("row__"))
    return plain.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def first_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: the longest first, each into the first bin with room.

    A tournament tree over the bins holds the larger room of each pair, so the first
    bin with room is found by one walk from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length()) if n else 1
    tree = [most] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, most - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            room = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == room:
                break
            tree[node] = room
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, groups: int, most: int = 2048, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """Give each piece (id_col, start, length, ...) a sequence_id and an offset there.

    Pieces are dealt into `groups` by a hash of seed, document, start, ids and, where pieces has it, the
    column row (its document's place in the table), so that rows of one id are spread too. Each group is
    packed on its own, in one task. Ties in length are placed by document and start.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([id_col, "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), most)
        return group.drop(columns="group").assign(sequence_id=group["group"] * 2**32 + bins, offset=offsets)

    own = [id_col, "start", "ids_crc32", *(["row"] if "row" in pieces.columns and id_col != "row" else [])]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(groups)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInPandas(run, f"{kind}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, most: int = 2048, group_pieces: int = 2048, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of docs with their sequences, in randomised groups of about group_pieces pieces.

    The number of pieces is set from the count and bytes of the texts (some three bytes a token). With keep_ids,
    each row carries its ids, so that a sequence is its rows' ids in the order of
    offset. Empty tables give no rows; null and empty texts one piece of one id.
    """
    seen = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(seen["n"] + seen["bytes"] // (3 * most)) // group_pieces))
    return pack(tokenize(docs, tokenizer, end_id, most, keep_ids, id_col, text_col), groups, most, id_col=id_col).drop(*(["row"] if id_col != "row" else []))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
