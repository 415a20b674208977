"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import fold, give_back_memory, slices, table
from tidemill.llm._words import LOWER, NOT_SPACE, hashes, spans, stretch_hashes, totals

#: Words of one lattice, languages whose sums are made at once, and numbers held for words met of late or summed at once.
BLOCK, AT_ONCE, HELD = 8192, 16, 1 << 20
#: What is added to a piece's expected count.
SMOOTHING = 0.01


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """A fixed vocabulary of byte strings and all their beginnings, found by hash. Single bytes always belong to it."""

    SLOTS = 19

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            known = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
        known = sorted({*known, *(bytes([b]) for b in range(256))} - {b""})
        self.size, self.longest = len(known), max(map(len, known))
        beginnings = sorted({p[:n] for p in known for n in range(1, len(p) + 1)})
        rank = {p: k for k, p in enumerate(known)}
        self.none = len(beginnings)
        #: The piece that each beginning is, or -1.
        self.piece = np.array([*(rank.get(p, -1) for p in beginnings), -1], np.int32)
        ends = np.cumsum([len(p) for p in beginnings])
        self.keys = np.append(hashes(np.frombuffer(b"".join(beginnings), np.uint8), ends - [len(p) for p in beginnings], ends), np.uint64(0))
        self.slots = []
        left = np.arange(self.none)
        for shift in (64 - self.SLOTS, 0, self.SLOTS):
            slot = np.full(1 << self.SLOTS, self.none, np.int32)
            at = self._slot(self.keys[left], shift)
            slot[at] = left
            self.slots.append((slot, shift))
            left = left[slot[at] != left]
        if len(left):
            raise ValueError(f"two strings of {path} share a hash")

    def _slot(self, hashed: np.ndarray, shift: int) -> np.ndarray:
        return (hashed >> np.uint64(shift) & np.uint64((1 << self.SLOTS) - 1)).view(np.int64)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The beginning with each hash, or none where there is no such."""
        out = self.slots[0][0].take(self._slot(hashed, self.slots[0][1]))
        miss = np.flatnonzero(self.keys.take(out) != hashed)
        out[miss] = self.none
        for slot, shift in self.slots[1:]:
            other = slot.take(self._slot(hashed[miss], shift))
            same = self.keys.take(other) == hashed[miss]
            out[miss[same]] = other[same]
            miss = miss[~same]
        return out


class Sweep:
    """Edges of a lattice in the order of their ends' distance from where the sums begin."""

    def __init__(self, source: np.ndarray, target: np.ndarray, distance: np.ndarray, piece: np.ndarray) -> None:
        order = np.lexsort((target, distance))
        self.source, self.piece, target, distance = source[order], piece[order], target[order], distance[order]
        head = np.flatnonzero(np.diff(target, prepend=-1) != 0)
        self.target, steps = target[head], np.arange(1, int(distance.max(initial=0)) + 2)
        self.edge = np.searchsorted(distance, steps).tolist()
        self.group = np.searchsorted(distance[head], steps).tolist()
        self.head = head


class Lattice:
    """All segmentations of some byte strings into pieces.

    Sums over segmentations are kept for each place of a string, and scaled once every `longest` places, so that
    those of long strings neither vanish nor need another way; the logarithms of the scales are kept beside them.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> None:
        self.size, self.every = np.diff(offsets), pieces.longest
        word = np.repeat(np.arange(len(self.size)), self.size)
        self.first = offsets[:-1] + np.arange(len(self.size))
        self.nodes = len(data) + len(self.size)
        #: How often the sums of each string are scaled, and where its scales begin.
        self.scaled = np.maximum(self.size - 1, 0) // self.every
        self.scale = np.append(0, np.cumsum(self.scaled + 1))
        room, total, at = offsets[1:][word] - np.arange(len(data)), totals(data), np.arange(len(data))
        starts, lengths, found = [], [], []
        for n in range(1, pieces.longest + 1):
            at = at[room[at] >= n]
            known = pieces.find(stretch_hashes(total, at, at + n))
            at, known = at[known != pieces.none], known[known != pieces.none]
            piece = pieces.piece[known]
            some = piece >= 0
            starts.append(at[some]), found.append(piece[some]), lengths.append(np.full(some.sum(), n))
        start, piece, length = np.concatenate(starts), np.concatenate(found), np.concatenate(lengths)
        self.word = word[start].astype(np.int32)
        self.begin, self.piece = (start + self.word).astype(np.int32), piece
        self.end = (self.begin + length).astype(np.int32)
        self.ahead = Sweep(self.begin, self.end, self.end - self.first[self.word], piece)

    def _sums(self, sweep: Sweep, seeds: np.ndarray, chance: np.ndarray, sign: int, piece: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums by node, outward from seeds, and logarithms of the scales by string and number of scalings."""
        sums, scales = np.zeros((self.nodes, chance.shape[1])), np.zeros((int(self.scale[-1]), chance.shape[1]))
        sums[seeds] = 1
        piece = sweep.piece if piece is None else piece
        for step in range(len(sweep.edge) - 1):
            a, b, g, h = sweep.edge[step], sweep.edge[step + 1], sweep.group[step], sweep.group[step + 1]
            each = sums.take(sweep.source[a:b], 0) * chance.take(piece[a:b], 0)
            sums[sweep.target[g:h]] = np.add.reduceat(each, sweep.head[g:h] - a, axis=0)
            if (step + 1) % self.every == 0:
                nth = (step + 1) // self.every
                on = np.flatnonzero(self.scaled >= nth)
                nodes = seeds[on][:, None] + sign * (step + 1 - np.arange(self.every))
                most = np.maximum(sums[nodes].max(1), 1e-300)
                sums[nodes] /= most[:, None]
                scales[self.scale[on] + nth] = scales[self.scale[on] + nth - 1] + np.log(most)
        return sums, scales

    def logs(self, chance: np.ndarray, piece: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of the sum over all segmentations of each string, by language. piece: the row of chance for each edge, where chance has not all pieces."""
        sums, scales = self._sums(self.ahead, self.first, chance, 1, piece)
        return np.log(np.maximum(sums[self.first + self.size], 1e-300)) + scales[self.scale[:-1] + self.scaled]

    def expected(self, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected, each string counted with its weights by language."""
        last = self.first + self.size
        done, left = self.begin - self.first[self.word], last[self.word] - self.end
        alpha, up = self._sums(self.ahead, self.first, chance, 1)
        beta, down = self._sums(Sweep(self.end, self.begin, last[self.word] - self.begin, self.piece), last, chance, -1)
        whole = np.log(np.maximum(alpha[last], 1e-300)) + up[self.scale[:-1] + self.scaled]
        scaled, scale = self.scaled[self.word], self.scale[self.word]
        log = up[scale + np.minimum(-(-done // self.every), scaled)] + down[scale + np.minimum(-(-left // self.every), scaled)] - whole[self.word]
        share = alpha[self.begin] * chance[self.piece] * beta[self.end] * np.exp(log) * weight[self.word]
        return np.stack([np.bincount(self.piece, share[:, k], len(chance)) for k in range(chance.shape[1])], axis=1)


def spaced(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space before each: data and offsets."""
    size = end - begin + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at] = False
    out[inner] = data[np.repeat(begin - (at - np.arange(len(at))), size - 1) + np.arange(len(out) - len(at))]
    return out, np.append(at, len(out))


class Model:
    """Piece probabilities for each language: those of the pieces met in it, sorted by piece, and one for all others."""

    def __init__(self, path: str, languages: list[str], size: int, other: np.ndarray, piece: np.ndarray, language: np.ndarray, chance: np.ndarray) -> None:
        order = np.argsort(piece, kind="stable")
        self.path, self.languages, self.size, self.other = path, languages, size, other
        self.piece, self.language, self.met = piece[order], language[order], chance[order]

    def rows(self, pieces: np.ndarray) -> np.ndarray:
        """Probabilities of some pieces by language."""
        out = np.tile(self.other, (len(pieces), 1))
        low = np.searchsorted(self.piece, pieces, "left")
        n = np.searchsorted(self.piece, pieces, "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(pieces)), n), self.language[at]] = self.met[at]
        return out

    @property
    def chance(self) -> np.ndarray:
        """Probabilities of all pieces by language."""
        return self.rows(np.arange(self.size))

    def word_scores(self, pieces: Pieces, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(begin), len(self.languages)))
        for low in range(0, len(begin), BLOCK):
            lattice = Lattice(pieces, *spaced(data, begin[low : low + BLOCK], end[low : low + BLOCK]))
            met = np.zeros(self.size, bool)
            met[lattice.ahead.piece] = True
            rows, which = self.rows(np.flatnonzero(met)), (np.cumsum(met) - 1).take(lattice.ahead.piece)
            for k in range(0, len(self.languages), AT_ONCE):
                out[low : low + BLOCK, k : k + AT_ONCE] = lattice.logs(rows[:, k : k + AT_ONCE], which)
        return out


def _drawn_words(rows: DataFrame, docs_per_language: int, bytes_per_language: int, bytes_in_all: int = 32 << 20) -> tuple[list[str], DataFrame]:
    """Languages, and the words (lang, word, count) of documents drawn for each, a language's share of bytes_in_all at most."""
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], rows
    bytes_per_language = min(bytes_per_language, bytes_in_all // len(languages))
    parts = {lang: min(1.0, docs_per_language / r["n"], bytes_per_language / max(r["bytes"], 1)) for lang, r in sizes.items()}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, parts[lang])])
    drawn = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    words = drawn.select("lang", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    common = Window.partitionBy("lang").orderBy(F.desc("count"), F.xxhash64("word"))
    held = words.where(F.octet_length("word") <= bytes_per_language).withColumn("bytes", F.sum(F.octet_length("word")).over(common))
    return languages, held.where(F.col("bytes") <= bytes_per_language).drop("bytes")


def fit(
    docs: DataFrame, vocabulary: str | None = None, docs_per_language: int = 250, rounds: int = 3, bytes_per_language: int = 2 << 20, bytes_in_all: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from about docs_per_language documents of each language, drawn by a hash of id and text.

    About bytes_per_language of text are drawn at most, or the language's share of bytes_in_all where that is less, and of
    their distinct words the most frequent that come to as many bytes; this bounds the word list that comes to the
    driver. Languages are fitted one by one, and of each only the pieces met in it are kept. Rows whose language or text is null teach nothing;
    without other rows the model knows no language.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages, words = _drawn_words(rows, docs_per_language, bytes_per_language, bytes_in_all)
    pieces = Pieces(path)
    found = words.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")]) if languages else None
    place: dict[str, tuple[int, int]] = {}
    for x in pc.value_counts(found.column("lang")).to_pylist() if languages else []:
        place[x["values"]] = (sum(place[last]) if place else 0, x["counts"])
        last = x["values"]
    other, met = np.zeros(len(languages)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for k, lang in enumerate(languages):
        blocks = []
        for batch in found.slice(*place.get(lang, (0, 0))).to_batches(BLOCK):
            raw = [w.encode() for w in batch.column("word").to_pylist()]
            size = np.array([len(w) for w in raw], np.int64)
            ends = np.cumsum(size)
            blocks.append((Lattice(pieces, *spaced(LOWER[np.frombuffer(b"".join(raw), np.uint8)], ends - size, ends)), batch.column("count").to_numpy().astype(float)[:, None]))
        chance = np.full((pieces.size, 1), 1 / pieces.size)
        for _ in range(rounds):
            counts = sum((lattice.expected(chance, weight) for lattice, weight in blocks), np.full(chance.shape, SMOOTHING))
            chance = counts / counts.sum(0)
        seen = np.flatnonzero(counts[:, 0] != SMOOTHING) if rounds else np.zeros(0, np.int64)
        other[k] = SMOOTHING / counts.sum() if rounds else 1 / pieces.size
        met.append((seen, np.full(len(seen), k), chance[seen, 0]))
    model = Model(path, languages, pieces.size, other, *(np.concatenate(x) for x in zip(*met, strict=True)))
    del found, met
    give_back_memory()
    return model


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, lang_pred and score (the share of lang_pred in the summed likelihood).

    A text that is null or holds no letter, and any text where no language was learned,
    gets `und` and score 0. Of equally likely languages the first by name is given. A kept column named lang_pred or
    score raises ValueError.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    if {"lang_pred", "score"} & set(kept):
        raise ValueError("a kept column may not be named lang_pred or score")
    letters = docs.select(*dict.fromkeys([*kept, text_col]), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has_letter__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double"
    names = [*model.languages, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, width = _pieces(model.path), len(model.languages)
        # the words met of late: a slot for each value of the hash's high bits
        bits = min(17, (HELD // max(1, width)).bit_length() - 1)
        met, scores = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, width))
        for part in slices(batches, text_col):
            data = LOWER[part.data]
            begin, end, counts = spans(data, part.offsets, NOT_SPACE)
            hashed, of = hashes(data, begin, end), np.repeat(np.arange(len(part)), counts)
            likely = np.zeros((len(part), width))
            for low in range(0, len(begin) if width else 0, max(1, HELD // max(1, width))):
                some = slice(low, low + HELD // width)
                slot = (hashed[some] >> np.uint64(64 - bits)).astype(np.int64)
                each = scores[slot]
                new = np.flatnonzero(met[slot] != hashed[some])
                if len(new):
                    _, first, which = np.unique(hashed[some][new], return_index=True, return_inverse=True)
                    own = model.word_scores(pieces, data, begin[some][new[first]], end[some][new[first]])
                    each[new] = own[which]
                    met[slot[new[first]]], scores[slot[new[first]]] = hashed[some][new[first]], own
                head = np.flatnonzero(np.diff(of[some], prepend=-1))
                likely[of[some][head]] += np.add.reduceat(each, head, axis=0)
            sure = part.rows.column(part.rows.schema.get_field_index("has_letter__")).to_numpy(zero_copy_only=False).astype(bool)
            best = np.full(len(part), width)
            score = np.zeros(len(part))
            if width:
                top = likely.argmax(1)
                best[sure] = top[sure]
                score[sure] = (1 / np.exp(likely - likely.max(1, keepdims=True)).sum(1))[sure]
            own = [part.rows.column(part.rows.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names).take(pa.array(best)), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return letters.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
