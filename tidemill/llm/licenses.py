"""License notices in texts: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import slices, table
from tidemill.llm._words import ALNUM, LOWER, hashes, spans

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that may hold edits, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose": "zlib",
    "all rights reserved": "reserved",
}

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "found array<struct<label: string, start_byte: long, end_byte: long, edits: int>>"
)


def _hash_words(phrase: str) -> list[np.uint64]:
    out = []
    for word in phrase.encode().split():
        data = np.frombuffer(word, np.uint8)
        out.append(hashes(data, np.array([0]), np.array([len(data)]))[0])
    return out


class Notices:
    """Finds notices with at most a share of edits.

    A notice with k edits allowed is cut into k + 1 seeds. Edits can spoil k of them
    at most, so one stands exactly; only places around a seed are verified.
    """

    def __init__(self, notices: dict[str, str], edit_share: float) -> None:
        import ahocorasick
        import regex

        self.known, self.letters, seeds = [], [], {}
        for n, (text, label) in enumerate(notices.items()):
            edits = max(1, int(len(text) * edit_share))
            self.known.append((text, label, edits, regex.compile(rf"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}")))
            self.letters.append(Counter(text).most_common())
            cuts = np.linspace(0, len(text), edits + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Each notice found in text: its number, begin, end and edits.

        Words stand with one space between them, and a line end parts two texts. A match is a run of whole
        words of one line; of overlapping ones of a notice, that with the least edits counts.
        """
        tried, every = set(), []
        for last, (size, uses) in self.automaton.iter(text):
            for n, at in uses:
                begin = last + 1 - size - at
                if (n, begin) in tried:
                    continue
                tried.add((n, begin))
                known, _, edits, pattern = self.known[n]
                around, missing = text[max(0, begin - edits) : begin + len(known) + edits], edits
                for letter, count in self.letters[n]:  # a match lacks no more of the notice's letters than it has edits
                    missing -= max(0, count - around.count(letter))
                    if missing < 0:
                        break
                if missing < 0:
                    continue
                line = text.rfind("\n", max(0, begin - edits), last + 1 - size) + 1
                stop = text.find("\n", last, begin + len(known) + edits + 1)
                stop = len(text) if stop < 0 else stop
                starts = [a for a in range(max(line, begin - edits, 0), begin + edits + 1) if a == 0 or text[a - 1 : a] in (" ", "\n")]
                ends = [b for b in range(begin + len(known) - edits, min(stop, begin + len(known) + edits) + 1) if b == len(text) or text[b : b + 1] in (" ", "\n")]
                for a in starts:
                    for b in ends:
                        if abs(b - a - len(known)) <= edits and (m := pattern.fullmatch(text, a, b)):
                            every.append((sum(m.fuzzy_counts), n, a, b))
        found: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[int]] = {}
        for edits, n, a, b in sorted(set(every)):
            own = taken.setdefault(n, [])
            at = bisect.bisect_right(own, a)
            if at % 2 == 0 and (at == len(own) or own[at] >= b):
                own[at:at] = [a, b]
                found.append((n, a, b, edits))
        return found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, edit_share: float = 0.12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and SCHEMA for every document.

    A-Z are lower-cased and words are runs of ASCII letters, digits and bytes beyond
    ASCII. n_base counts the places of all phrases; first_word and last_word are the
    least and largest of them, null where there is none. labels holds base_labels and
    those of the notices found with edits in up to edit_share of their characters.
    score is the best likeness of any: 1 for a phrase or an exact notice, 0 for none.
    found has each notice's place in the text's UTF-8 bytes. Null text counts as empty;
    other columns of docs are left out.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Notices(notices, edit_share)
        base = [(_hash_words(p), label) for p, label in phrases.items()]
        for part in slices(batches, text_col):
            n, data = len(part), LOWER[part.data]
            begin, end, counts = spans(data, part.offsets, ALNUM)
            edge = np.append(0, np.cumsum(counts))
            of = np.repeat(np.arange(n), counts)
            word = hashes(data, begin, end)
            labels: list[set[str]] = [set() for _ in range(n)]
            n_base = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for words, label in base:
                met = word == words[0]
                for k, w in enumerate(words[1:], 1):
                    met[: len(word) - k] &= (word[k:] == w) & (of[k:] == of[: len(word) - k])
                    met[max(0, len(word) - k) :] = False
                at = np.flatnonzero(met)
                np.add.at(n_base, of[at], 1)
                np.minimum.at(low, of[at], at - edge[of[at]])
                np.maximum.at(high, of[at], at - edge[of[at]])
                for d in np.unique(of[at]).tolist():
                    labels[d].add(label)
            base_labels = [",".join(sorted(x)) for x in labels]
            score = (n_base > 0).astype(float)
            found: list[list[dict]] = [[] for _ in range(n)]
            # the words again, one space after each, a line end after a text's last
            size = end - begin
            start = np.cumsum(size + 1) - size - 1
            flat = np.full(int((size + 1).sum()), 0x20, np.uint8)
            flat[(start + size)[edge[1:][counts > 0] - 1]] = 0x0A
            inner = np.ones(len(flat), bool)
            inner[start + size] = False
            flat[inner] = data[np.repeat(begin - start + np.arange(len(start)), size) + np.arange(len(flat) - len(start))] if len(start) else 0
            for k, a, b, edits in sorted(finder.find(flat.tobytes().decode("latin-1"))):
                first, last = np.searchsorted(start, [a, b - 1], "right") - 1
                d = int(of[first])
                text, label = finder.known[k][:2]
                labels[d].add(label)
                score[d] = max(score[d], 1 - edits / len(text))
                found[d].append({"label": label, "start_byte": int(begin[first] - part.offsets[d]), "end_byte": int(end[last] - part.offsets[d]), "edits": edits})
            none = n_base == 0
            ids = part.rows.column(part.rows.schema.get_field_index(id_col))
            out = {
                id_col: ids, "n_words": pa.array(counts), "n_base": pa.array(n_base), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none), "base_labels": pa.array(base_labels, pa.string()),
                "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()), "score": pa.array(score),
                "found": pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("found", lambda f: F.concat_ws(":", f["label"], f["start_byte"].cast("string"), f["end_byte"].cast("string"), f["edits"].cast("string")))
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("found", F.array_join(each, ","))
