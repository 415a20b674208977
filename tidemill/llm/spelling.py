"""Spelling variants: words one edit apart, met in equal bands of their letters' parities."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import slices, stored, table
from tidemill.llm.sharding import _CRC

#: A word's letters, common ones first so that each band holds as many of them.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = regex.compile("[A-Za-zÀ-ÿ]++")
#: Bits of a band. 63 bits hold 90 letters, so the rarest share a bit; an edit flips two bits at most all the same.
WIDTH = 21
#: Characters of a text whose words are counted at once.
STRETCH = 1 << 20

_BIT = np.zeros(256, np.int64)
for _k, _letter in enumerate(LETTERS):
    _BIT[ord(_letter)] = 1 << (WIDTH * (_k % 3) + _k // 3 % WIDTH)


def parities(words: list[str]) -> np.ndarray:
    """For each word, which letters it has an odd number of times, a bit each; no word may be empty."""
    starts = np.cumsum([0, *map(len, words)])[:-1]
    return np.bitwise_xor.reduceat(_BIT[np.frombuffer("".join(words).encode("latin-1"), np.uint8)], starts) if words else np.zeros(0, np.int64)


def _stretches(text: str) -> Iterator[str]:
    """text in stretches of about STRETCH characters, none of which cuts a word."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text) and (rest := RUN.match(text, end)):
            end = rest.end()
        yield text[at:end]
        at = end


def count_words(docs: DataFrame, least_length: int, spoil_every: int | None, id_col: str, text_col: str) -> DataFrame:
    """word and n, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            ids = part.rows.column(0).to_pylist()
            total: Counter[str] = Counter()
            for d, low, high in zip(ids, part.offsets, part.offsets[1:], strict=False):
                head = zlib.crc32(f"{'' if d is None else d}:".encode())
                for text in _stretches(part.data[low:high].tobytes().lower().decode()):  # bytes.lower() knows A-Z only
                    for word, n in Counter(RUN.findall(text)).items():
                        if spoil_every and (h := zlib.crc32(word.encode(), head)) % spoil_every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _band(k: int, mask: str = "mask") -> Column:
    return F.shiftright(mask, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(size: Column, cut: Column, after: Column, bands: list[tuple[int, ...]]) -> list[Column]:
    """A key for the named bands, a length, and either end of the word: what stands before `cut`, and what stands from `after` on."""
    ends = (F.substring("word", F.lit(1), cut), F.substring("word", after + 1, F.col("size")))
    return [F.xxhash64(F.lit(len(k)), F.lit(k[0]), F.lit(side), *[_band(i) for i in k], size, end) for k in bands for side, end in enumerate(ends)]


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words (word, n, mask, size) that one inserted, deleted or replaced code point parts: a, n_a, b, n_b, each pair once.

    A replaced letter flips two parities, so of three bands at least one stays equal; an inserted one flips a single
    parity, so two stay. Words join on the bands left equal and the length. As words of one length and
    band are many in a large vocabulary, the key also has the half of the word before or behind the edit, which stays as it is.
    A pair counts in the first band and half where it meets.
    """
    size, half = F.col("size"), F.floor(F.col("size") / 2).cast("int")
    short = F.floor((F.col("size") - 1) / 2).cast("int")
    one, two = [(0,), (1,), (2,)], [(0, 1), (0, 2), (1, 2)]
    same = _keys(size, half, half, one)
    left = words.select("word", "n", "mask", "size", F.posexplode(F.array(*same, *_keys(size, half, half, two))).alias("nth", "key"))
    right = words.select("word", "n", "mask", F.posexplode(F.array(*same, *_keys(size - 1, short, short + 1, two))).alias("nth", "key")).toDF("b", "n_b", "mask_b", "nth_b", "key_b")
    flips = F.col("mask").bitwiseXOR(F.col("mask_b"))
    earlier = [flips.bitwiseAND(F.lit(((1 << WIDTH) - 1) << (WIDTH * k))) != 0 for k in (0, 1)]
    once = (F.col("nth") >= 6) | ((F.col("word") < F.col("b")) & ((F.col("nth") < 2) | earlier[0]) & ((F.col("nth") < 4) | earlier[1]))
    before = F.substring("word", F.lit(1), half) == F.substring("b", F.lit(1), half)
    met = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("nth") == F.col("nth_b")) & (F.bit_count(flips) <= 2) & once & ((F.col("nth") % 2 == 0) | ~before) & (F.levenshtein("word", "b", 1) == 1))
    return met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "b", "n_b")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, spoil_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the texts that is long and common enough.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased; those of least_length code
    points that stand least_count times over all texts count. A word's form is the word one edit away that
    stands most often (of equals the first in code-point order), if it stands `times` as often; root is what forms lead
    to in the end, the word itself where it has none. spoil_every plants mistakes: a word loses the code point that the
    CRC-32 of `<id>:<word>` names where spoil_every divides it; a null id is written as nothing.
    Null and empty texts have no words; repeated rows count each time; other columns are not read. No words give no rows.
    """
    counted = count_words(docs, least_length, spoil_every, id_col, text_col).where(F.col("n") >= least_count)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parities(own)), pa.array(list(map(len, own)), pa.int32())], names=["word", "n", "mask", "size"])

    words = stored(counted.mapInArrow(mask, "word string, n long, mask long, size int"))
    pairs = stored(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    formed = words.select("word", "n").join(near, "word", "left")
    most = -F.col("best.m")
    fits = most >= times * F.col("n")
    formed = stored(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, most).alias("form_n")))
    # forms of forms: each round doubles the steps made, and a word stands `times` as seldom as its form
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while times > 1:
        nodes = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(nodes, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = formed.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), spoil_every=31)


OP12_SQL = f"""
WITH RECURSIVE {_CRC.strip().rstrip(",")},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + strlen(doc || ':' || run)), lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295)::BIGINT AS h FROM d, crc),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
l AS (SELECT DISTINCT p.word AS a, p.n AS na, w.word AS b, w.n AS nb FROM p JOIN w ON p.rest = w.word),
e AS (SELECT x.word AS a, y.word AS b, y.n AS m FROM p x JOIN p y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word UNION ALL SELECT a, b, nb FROM l UNION ALL SELECT b, a, na FROM l),
k AS (SELECT a, b, m, count(*) OVER (PARTITION BY a) AS n_near FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY m DESC, b) = 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN k ON a = word),
c AS (SELECT word, word AS led, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.led WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(led, steps) AS root FROM c GROUP BY word) USING (word)
"""
