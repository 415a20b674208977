"""Passages that an earlier document holds too, found by FM-indexes over shards of what may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import Slice, discard, give_back_memory, lists, slices, stored, table
from tidemill.llm._words import NOT_SPACE, _power_tables, grams, hashes, mix, spans
from tidemill.llm.fm_index import FMIndex

#: Words of an anchor, windows of a first document that share a route, and windows in one streamed piece.
ANCHOR, STRETCH, PIECE = 12, 1024, 256
#: A route with an anchor of more rows is hot; words of one shard, about.
HOT, SHARD_WORDS = 256, 1 << 17
#: A window with one of so many parts of all hot windows is heavy; there are as many heavy ones at most.
HEAVY_PARTS = 8192
#: As many word ranges (about 12 MB) are sent to every task; more are joined by exchange.
FEW_RANGES = 1 << 19


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out, reach = np.minimum(out[:-step], out[step:]), reach + step
    return out


def anchors(part: Slice, window: int) -> tuple[np.ndarray, ...]:
    """For each text its number of words and a 128-bit hash of their sequence, and of all texts the anchors.

    An anchor is the run of ANCHOR words with the least hash in a window, so equal windows have
    equal anchors. Anchors: text, hash, first window and the window behind the last of those
    that chose it.
    """
    begin, end, counts = spans(part.data, part.offsets, NOT_SPACE)
    word = hashes(part.data, begin, end)
    edge = np.append(0, np.cumsum(counts))
    up, down = _power_tables(len(word) + 1)
    sequence = []
    for w in (word, mix(word ^ np.uint64(0x2545F4914F6CDD1D))):
        total = np.append(np.uint64(0), np.cumsum(w * up[: len(w)]))
        sequence.append(mix((total[edge[1:]] - total[edge[:-1]]) * down[edge[:-1]] + counts.astype(np.uint64)))
    gram = np.full(max(0, len(word) - ANCHOR + 1), np.uint64(2**64 - 1))
    hashed, place = grams(word, counts, ANCHOR)
    gram[place] = hashed
    ranked = (gram >> np.uint64(28) << np.uint64(28)) | np.arange(len(gram), dtype=np.uint64)
    none = np.zeros(0, np.int64)
    if len(word) < window:
        return counts, *sequence, none, none, none, none
    chosen = (_sliding_least(ranked, window - ANCHOR + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[: len(chosen)] == text[window - 1 :])
    if not len(inside):
        return counts, *sequence, none, none, none, none
    anchor, of = chosen[inside], text[inside]
    head = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    last = np.append(head[1:], len(inside)) - 1
    return counts, *sequence, of[head], gram[anchor[head]].view(np.int64), inside[head] - edge[of[head]], inside[last] + 1 - edge[of[head]]


def _anchor_table(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, low, high, of, hashed, start, stop = anchors(part, window)
            columns = [part.rows.column(0), pa.array(counts), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))]
            columns += [lists(x, np.bincount(of, minlength=len(part)), k) for x, k in ((hashed, pa.int64()), (start, pa.int32()), (stop, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "low", "high", "anchor", "start", "stop"])

    return docs.mapInArrow(run, "id long, n_words long, low long, high long, anchor array<long>, start array<int>, stop array<int>")


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """Words of the marked windows of each text (id, text, marks), in pieces of one route.

    A mark's role is 1 for windows to be indexed, 2 for those to be searched for, 3 for both. Of a route in several parts, pieces to
    be searched for are dealt out by document, and those to be indexed go to each part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            begin, end, counts = spans(part.data, part.offsets, NOT_SPACE)
            edge = np.append(0, np.cumsum(counts)).tolist()
            raw, ids = part.data.tobytes(), part.rows.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("route", "salt", "salts", "id", "begin", "role", "words", "text")}
            for k, marks in enumerate(part.rows.column(2).to_pylist()):
                runs: list[list[int]] = []
                for m in sorted({(m["start"], m["stop"], m["route"], m["salts"], m["role"]) for m in marks}):
                    if runs and runs[-1][1] == m[0] and runs[-1][2:] == list(m[2:]):
                        runs[-1][1] = m[1]
                    else:
                        runs.append(list(m))
                for start, stop, route, salts, role in runs:
                    for low in range(start, stop, PIECE):
                        high = min(low + PIECE, stop) + window - 1
                        a, b = edge[k] + low, edge[k] + high
                        for key, value in zip(out, (route, int(mix(np.array([ids[k]]).astype(np.uint64))[0] % np.uint64(salts)), salts, ids[k], low, role, high - low, b" ".join(raw[begin[i] : end[i]] for i in range(a, b))), strict=True):
                            out[key].append(value)
            kinds = {"salt": pa.int32(), "salts": pa.int32(), "role": pa.int32(), "text": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    pieces = texts.mapInArrow(run, "route long, salt int, salts int, id long, begin long, role int, words long, text binary")
    parts = F.when((F.col("role") == 1) & (F.col("salts") > 1), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("salt"))
    return pieces.withColumn("salt", F.explode(parts))


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """A 128-bit hash of each window of the hot routes, and where it stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            begin, end, counts = spans(part.data, part.offsets, NOT_SPACE)
            word, edge = hashes(part.data, begin, end), np.append(0, np.cumsum(counts))
            up, down = _power_tables(len(word) + 1)
            totals = [np.append(np.uint64(0), np.cumsum(w * up[: len(w)])) for w in (word, mix(word ^ np.uint64(0x2545F4914F6CDD1D)))]
            ids = part.rows.column(0).to_pylist()
            for k, marks in enumerate(part.rows.column(2).to_pylist()):
                hot = [m for m in marks if m["hot"]]
                if not hot:
                    continue
                at = np.concatenate([np.arange(m["start"], m["stop"]) for m in hot])
                a = edge[k] + at
                low, high = (mix((t[a + window] - t[a]) * down[a]).view(np.int64) for t in totals)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (low, high, np.full(len(at), ids[k]), at)], names=["low", "high", "id", "start"])

    return texts.mapInArrow(run, "low long, high long, id long, start long")


def _repeats(windows: DataFrame, heavy: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """id, start, route and role of the windows (low, high, id, start) that stand in several documents.

    Rows come sorted by hash, id and start, and all of a hash in one task but for those of heavy, a bounded number of hashes whose first
    places are given. The first place gets role 1, those in later documents 2; a route is the stretch of the first place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, told = None, (0, 0), False
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high, ids, start = (batch.column(k).to_numpy() for k in range(4))
            head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            keys = list(zip(low[head].tolist(), high[head].tolist(), strict=True))
            firsts = [heavy.get(k, f) for k, f in zip(keys, zip(ids[head].tolist(), start[head].tolist(), strict=True), strict=True)]
            if keys[0] == before:
                firsts[0] = first
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(low))))
            first_id, first_start = (np.array([f[i] for f in firsts], np.int64) for i in (0, 1))
            later = ids > first_id[of]
            any_later = np.logical_or.reduceat(later, head)
            # the first place is given once, by whichever batch shows a later document first; a heavy hash's where it stands
            given = any_later & np.array([k not in heavy for k in keys])
            given[0] &= not (keys[0] == before and told)
            own = np.array([k in heavy for k in keys])[of] & (ids == first_id[of]) & (start == first_start[of])
            some, ones = np.flatnonzero(later), np.flatnonzero(own)
            g = np.flatnonzero(given)
            out = [np.concatenate(x) for x in ((ids[some], ids[ones], first_id[g]), (start[some], start[ones], first_start[g]), (first_id[of[some]], first_id[of[ones]], first_id[g]), (first_start[of[some]], first_start[of[ones]], first_start[g]))]
            route = mix(mix(out[2].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + (out[3] // STRETCH).astype(np.uint64)).view(np.int64)
            role = np.append(np.full(len(some), 2, np.int32), np.ones(len(ones) + len(g), np.int32))
            told = bool(any_later[-1]) or (len(keys) == 1 and keys[0] == before and told)
            before, first = keys[-1], firsts[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(route), pa.array(role)], names=["id", "start", "route", "role"])

    deal = F.when(F.col("low").isin([k[0] for k in heavy]), F.xxhash64("id")).otherwise(F.lit(0)) if heavy else F.lit(0)
    ordered = windows.withColumn("deal", deal).repartition("low", "high", "deal").sortWithinPartitions("low", "high", "id", "start")
    return ordered.select("low", "high", "id", "start").mapInArrow(run, "id long, start int, route long, role int")


def _hot_marks(texts: DataFrame, window: int) -> DataFrame:
    """id and marks of what repeats among the windows of hot routes: id, text, marks.

    A window that stands in several documents is routed anew, by where it stands first, so each is indexed once. A new route
    indexes the windows of one stretch of a document at most; where many search it, it has several parts, each with that small index.
    """
    windows = stored(_window_hashes(texts.where(F.exists("marks", lambda m: m["hot"])), window))
    total = windows.count()
    counts = windows.groupBy("low", "high").agg(F.min(F.struct("id", "start")).alias("f"), F.max("id").alias("last"), F.count("*").alias("n"))
    heavy = {(r["low"], r["high"]): (r["f"]["id"], r["f"]["start"]) for r in counts.where((F.col("n") * HEAVY_PARTS >= total) & (F.col("n") > HOT) & F.expr("f.id < last")).collect()}
    met = stored(_repeats(windows, heavy).groupBy("id", "route", "role").agg(F.collect_list("start").alias("starts")))
    discard(windows)
    salts = stored(met.where("role = 2").groupBy("route").agg(F.ceil(F.sum(F.size("starts")) / SHARD_WORDS).cast("int").alias("salts")))
    marks = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + 1).alias("stop"), F.col("route"), F.col("salts"), F.col("role")))
    return met.join(salts, "route").groupBy("id").agg(F.flatten(F.collect_list(marks)).alias("hot_marks"))


def _search(group: pa.Table, window: int) -> pa.Table:
    """Word ranges of the pieces to be searched for that stand in an indexed piece of a lesser id."""
    give_back_memory()
    text = group.column("text").combine_chunks()
    ids, role = group.column("id").to_numpy(), group.column("role").to_numpy()
    begins = group.column("begin").to_numpy()
    code = text.dictionary_encode().indices.to_numpy()
    least = np.full(code.max() + 1, np.iinfo(np.int64).max)
    indexed = (role & 1) > 0
    np.minimum.at(least, code[indexed], ids[indexed])
    first = np.unique(code, return_index=True)[1]
    raw = text.to_pylist()
    offsets = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin, end, counts = spans(data, offsets, NOT_SPACE)
    word, edge = hashes(data, begin, end), np.append(0, np.cumsum(counts))
    chosen = first[least[code[first]] < np.iinfo(np.int64).max]
    searched = np.flatnonzero(role & 2)
    out: dict[str, list] = {"id": [], "begin": [], "end": []}
    if len(chosen) and len(searched):
        vocabulary = np.unique(np.concatenate([word[edge[i] : edge[i + 1]] for i in chosen]))
        known = np.searchsorted(vocabulary, word)
        codes = np.where(vocabulary[np.minimum(known, len(vocabulary) - 1)] == word, known + 1, -1)
        texts = np.concatenate([np.append(codes[edge[i] : edge[i + 1]], 0) for i in chosen])
        index = FMIndex(texts, np.repeat(least[code[chosen]], counts[chosen] + 1), len(vocabulary))
        met = index.matching(codes, edge[searched], edge[searched + 1], ids[searched]) >= window
        for i in searched:
            own = np.flatnonzero(np.diff(met[edge[i] : edge[i + 1]].astype(np.int8), prepend=0, append=0))
            for a, b in zip(own[::2].tolist(), own[1::2].tolist(), strict=True):
                out["id"].append(int(ids[i])), out["begin"].append(int(begins[i]) + a), out["end"].append(int(begins[i]) + b + window - 1)
        del index, texts, codes, vocabulary, known
    del raw, data, word, begin, end, text
    give_back_memory()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, begin, end: ranges of words that lie in windows which a document of a lesser id holds too.

    Texts of equal words are one class; all but the least id repeat wholly. The others are cut at
    anchors, and only windows whose anchor stands in several documents go on. They are routed by
    where the anchor's first document holds it, so that all windows of an anchor meet in one shard,
    which indexes and searches them. A route with an anchor in over HOT rows is hot: its windows are
    first counted, and only those that repeat go on, each by a route of its own first place.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stored(_anchor_table(plain, window))
    classes = stored(made.where(F.col("n_words") >= window).groupBy("low", "high").agg(F.min("id").alias("first")))
    firsts = made.join(classes.select(F.col("first").alias("id")), "id", "left_semi").where(F.col("n_words") >= window)
    rows = firsts.select("id", F.explode(F.arrays_zip("anchor", "start", "stop")).alias("x")).select("id", "x.*")
    shared = rows.groupBy("anchor").agg(F.min(F.struct("id", "start")).alias("f"), F.max("id").alias("last"), F.count("*").alias("n")).where("f.id < last")
    shared = stored(shared.select("anchor", "n", F.col("f.id").alias("first"), F.xxhash64("f.id", F.floor(F.col("f.start") / STRETCH)).alias("route")))
    hot = shared.groupBy("route").agg((F.max("n") > HOT).alias("hot"))
    marks = rows.join(stored(shared.join(hot, "route").drop("n")), "anchor")
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "route", F.when(F.col("id") == F.col("first"), 1).otherwise(3).alias("role"), "hot")).alias("marks"))
    texts = stored(plain.join(marks.hint("shuffle_hash"), "id").select("id", "text", "marks"))
    # of an anchor's first document windows are indexed only; the hot routes' windows go by routes of their own
    cool = F.transform(F.filter("marks", lambda m: ~m["hot"]), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["route"].alias("route"), F.lit(1).alias("salts"), m["role"].alias("role")))
    hot_marks = stored(_hot_marks(texts, window))
    every = F.concat(cool, F.coalesce("hot_marks", F.array().cast("array<struct<start:int,stop:int,route:long,salts:int,role:int>>")))
    pieces = stored(_pieces(texts.join(hot_marks, "id", "left").select("id", "text", every.alias("marks")), window))
    words = pieces.agg(F.sum("words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("route", "salt"), F.lit(max(1, -(-words // SHARD_WORDS))))
    found = pieces.select(shard.alias("shard"), "id", "begin", "role", "text").groupBy("shard").applyInArrow(lambda t: _search(t, window), "id long, begin long, end long")
    copies = made.where(F.col("n_words") >= window).join(classes, ["low", "high"]).where("id > first").select("id", F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"))
    found = stored(found.union(copies))
    discard(made, classes, shared, texts, hot_marks, pieces)
    return found


def remove_spans(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words outside the ranges (id, begin, end), one space between them.

    Up to FEW_RANGES ranges, docs aren't exchanged.
    """
    grouped = ranges.groupBy(F.col("id").alias("id__")).agg(F.collect_list(F.struct("begin", "end")).alias("ranges__"))
    how = "broadcast" if ranges.count() <= FEW_RANGES else "shuffle_hash"
    joined = docs.drop("n_words", "n_removed", "kept_text").join(grouped.hint(how), F.col(id_col).cast("long") == F.col("id__"), "left").drop("id__")
    own = [f for f in joined.schema.fields if f.name != "ranges__"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            begin, end, counts = spans(part.data, part.offsets, NOT_SPACE)
            edge = np.append(0, np.cumsum(counts)).tolist()
            gone = np.zeros(len(begin), bool)
            for k, marks in enumerate(part.rows.column(part.rows.schema.get_field_index("ranges__")).to_pylist()):
                for m in marks or ():
                    gone[edge[k] + m["begin"] : min(edge[k] + m["end"], edge[k + 1])] = True
            kept, raw = [], part.data.tobytes()
            at, lost = part.offsets.tolist(), np.append(0, np.cumsum(gone))
            for k in range(len(part)):
                a, b = edge[k], edge[k + 1]
                words = raw[at[k] : at[k + 1]].split()
                if lost[b] > lost[a]:
                    words = [w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
                kept.append(b" ".join(words))
            removed = np.diff(lost[edge])
            columns = [part.rows.column(part.rows.schema.get_field_index(f.name)) for f in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=[*(f.name for f in own), "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text, after each word covered by a repeated window is gone.

    Words are runs of bytes other than ASCII white space. A window is `window` consecutive words of
    one document; it is repeated where the same words also start in a document of a lesser id,
    whatever is removed there. Null and empty texts have no words, and an id stands for one text: rows
    that repeat it are treated alike. Rows with a null id lose nothing and make nothing repeat. Columns
    of docs by those three names are replaced.
    """
    return remove_spans(docs, repeated_spans(docs, window, id_col, text_col), id_col, text_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, d.w, g.ps FROM d LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS t FROM u ANTI JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY u.doc_id)
SELECT k.doc_id, k.n_words, k.n_removed, sha256(coalesce(t.t, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)
"""
