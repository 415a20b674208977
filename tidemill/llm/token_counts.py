"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm._spark import slices, table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class LongestMatch:
    """A vocabulary trie with failure links.

    Where a node has no edge for the next byte, its failure link leads to the node of
    what is left after the longest pieces have been taken off its front; popped holds
    how many those are. A word is so counted in one pass, and no piece is built. Every
    single byte is a piece, so that any word can be cut.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        edges: dict[int, int] = {}
        ends = [False]
        for piece in dict.fromkeys([*pieces, *(bytes([b]) for b in range(256))]):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(False)
                node = edges[key]
            ends[node] = bool(node)
        self.edges, self.link, self.popped = edges, [0] * len(ends), [0] * len(ends)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in edges.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        level = [0]
        while level:
            following = []
            for up in level:
                for byte, node in below.get(up, ()):
                    following.append(node)
                    if ends[node]:
                        self.popped[node] = 1
                        continue
                    count, z = self.popped[up], self.link[up]
                    while (z << 8 | byte) not in edges:
                        count, z = count + self.popped[z], self.link[z]
                    self.link[node], self.popped[node] = edges[z << 8 | byte], count
            level = following

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            while (key := node << 8 | byte) not in edges:
                total += popped[node]
                node = link[node]
            node = edges[key]
        while node:
            total += popped[node]
            node = link[node]
        return total


@lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatch:
    """One for each Python worker."""
    return LongestMatch(read_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, keep: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_words and n_tokens of every text.

    Words are what stands between ASCII white space; each is counted with one space
    before it, as greedy longest pieces of the vocabulary. The last `keep` words of up to
    64 bytes are remembered in a task. Null and empty texts have noughts; other columns
    of docs are left out.
    """
    path = vocabulary or default_vocabulary()
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_words long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, met = _automaton(path).count, {}
        for part in slices(batches, text_col):
            raw, at = part.data.tobytes(), part.offsets.tolist()
            n_words, n_tokens = [], []
            for a, b in zip(at, at[1:], strict=False):
                words = raw[a:b].split()
                for word in set(words).difference(met):
                    met[word] = count(b" " + word)
                n_words.append(len(words))
                n_tokens.append(sum(map(met.__getitem__, words)))
                if len(met) > keep:
                    met = {}
                elif words and len(max(words, key=len)) > 64:
                    met = {w: n for w, n in met.items() if len(w) <= 64}
            ids = part.rows.column(part.rows.schema.get_field_index(id_col))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(part.offsets)), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
