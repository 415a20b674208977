"""Near-duplicate documents by a forest of sorted MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._components import components
from tidemill.llm._spark import Slice, discard, lists, slices, stored, table
from tidemill.llm._words import LOWER, NOT_SPACE, grams, hashes, mix, spans

#: Trees, and values in a tree's first key. A pair of similarity 0.8 shares the key of some tree
#: but for a chance of (1 - 0.8**6)**40 = 5e-6.
TREES, DEPTH = 40, 6
#: A region of more documents is parted by its next values, PARTS of them in all, STEP at a time, each held in VALUE_BITS.
REGION, PARTS, STEP, VALUE_BITS = 64, 6, 2, 10
#: Rows of a group whose pairs are looked at one by one; larger groups are compared in blocks of about BLOCK rows on either side.
FEW, BLOCK = 32, 512
#: Shingles are ranked by how often their bucket occurs; sizes in one class differ by less than this factor.
BUCKETS, CLASS = 1 << 18, 1.02

_rng = np.random.default_rng(811)
_XOR = _rng.integers(0, 2**64, TREES * DEPTH, np.uint64)
_ODD = _rng.integers(0, 2**64, TREES * DEPTH, np.uint64) | np.uint64(1)


def shingle_sets(part: Slice, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text end to end, and how many each has."""
    data = LOWER[part.data]
    begin, end, counts = spans(data, part.offsets, NOT_SPACE)
    word = hashes(data, begin, end)
    gram, place = grams(word, counts, words_each)
    edge = np.append(0, np.cumsum(counts))
    cut = np.searchsorted(place, edge)
    sets = []
    for k, n in enumerate(counts.tolist()):
        if n >= words_each:
            sets.append(np.unique(gram[cut[k] : cut[k + 1]]))
        elif n:
            whole = np.array([n], np.uint64)
            for h in word[edge[k] : edge[k + 1]]:
                whole = mix(whole * np.uint64(31) + h)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def signatures(docs: DataFrame, words_each: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, a 128-bit hash of the shingle set, and for each tree a shallow and a deep key.

    Tree t orders documents by the signature's six values from 6 t on, whose hash is the shallow key, and then by
    one value of each of six other trees, the first VALUE_BITS bits of which stand end to end in the deep key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            flat, n = shingle_sets(part, words_each)
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]
            least = np.zeros((len(n), TREES * DEPTH), np.uint64)
            low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                low[some], high[some] = np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for k in range(TREES * DEPTH):
                    least[some, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts)
            blocks = least.reshape(len(n), TREES, DEPTH)
            shallow = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(n), TREES)).copy()
            for k in range(DEPTH):
                shallow = mix(shallow * np.uint64(31) + blocks[:, :, k])
            deep = np.zeros_like(shallow)
            for k in range(PARTS):
                own = np.roll(blocks[:, :, k % DEPTH], -1 - 7 * k, axis=1)
                deep = deep << np.uint64(VALUE_BITS) | mix(own) >> np.uint64(64 - VALUE_BITS)
            ids, each = part.rows.column(part.rows.schema.get_field_index("id")), np.full(len(n), TREES)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists(shallow.ravel().view(np.int64), each, pa.int64()), lists(deep.ravel().view(np.int64), each, pa.int64())],
                names=["id", "n", "set_low", "set_high", "shallow", "deep"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, set_low long, set_high long, shallow array<long>, deep array<long>")


def shingle_table(docs: DataFrame, words_each: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            flat, n = shingle_sets(part, words_each)
            ids = part.rows.column(part.rows.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, lists(flat.view(np.int64), n, pa.int64())], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, shingles array<long>")


def _predecessors(rows: DataFrame) -> DataFrame:
    """Pairs of neighbours in the sorted order of each tree that share the shallow key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before, id_before = None, None
        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if key_before is not None:
                key, own = np.append(key_before, key), np.append(id_before, own)
            same = np.flatnonzero((key[1:] == key[:-1]) & (own[1:] != own[:-1]))
            key_before, id_before = key[-1:], own[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[same], own[same + 1])), pa.array(np.maximum(own[same], own[same + 1]))], names=["a", "b"])

    ordered = rows.repartitionByRange("key", "deep", "id").sortWithinPartitions("key", "deep", "id").select("key", "id")
    return ordered.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs a, b whose full sets are similar."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(one, "a").join(two, "b").where(both * 100 >= F.lit(round(threshold * 100)) * (F.size("s") + F.size("t") - both)).select("a", "b")


def _levels(shared: DataFrame) -> DataFrame:
    """key, id and fame for every region, and for the parts of large regions, by as many more values as it takes."""
    level = shared.select("key", "deep", "id", "fame", "n")
    out, most = level.select("key", "id", "fame"), level.agg(F.max("n")).first()[0] or 0
    for left in range(PARTS - STEP, -1, -STEP):
        if most <= REGION:
            break
        parts = level.where(F.col("n") > REGION).select(F.xxhash64("key", F.shiftright("deep", left * VALUE_BITS)).alias("key"), "deep", "id", "fame")
        level = stored(parts.join(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        out, most = out.union(level.select("key", "id", "fame")), level.agg(F.max("n")).first()[0] or 0
    return out


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """group, id and component: rows that share a group are all that may be similar.

    rows: id, component and shingles. Similar sets share one of the first of their shingles, the rarest first; how many of these
    must be looked at follows from both sizes, so a group is a shingle and the classes of two sizes, both of which have rows in it. Classes are
    narrow, since a set looked at as if the other were smaller is looked at too far: sets of one template, alike by a little less than the threshold, would all meet at the template's own shingles.
    """
    counts = rows.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(BUCKETS)).cast("int").alias("bucket")).count().toPandas()
    often = np.zeros(BUCKETS, np.int64)
    often[counts["bucket"].to_numpy(np.int64)] = counts["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(2)
            size = np.asarray(sets.value_lengths()).astype(np.int64)
            flat, owner = np.asarray(sets.flatten()), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, often[flat % BUCKETS], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            some = np.flatnonzero(place < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner])
            out = [pa.array(flat[order[some]]), batch.column(0).take(pa.array(owner[some])), batch.column(1).take(pa.array(owner[some])), pa.array(size[owner[some]]), pa.array(place[some])]
            yield pa.RecordBatch.from_arrays(out, names=["shingle", "id", "component", "n", "place"])

    def apart(groups: DataFrame, key: str) -> DataFrame:
        return groups.join(groups.groupBy(key).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select(key), key)

    first = apart(stored(rows.mapInArrow(run, "shingle long, id long, component long, n long, place long")), "shingle")
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(CLASS)) + 1e-9)
    reach = int(np.ceil(np.log(1 / threshold) / np.log(CLASS)))
    sized = first.withColumn("class", own).withColumn("other", F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach)))
    least = F.greatest(F.ceil(F.pow(F.lit(CLASS), "other") - 1e-6), F.lit(threshold) * F.col("n"), F.lit(1.0))
    both = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + least) - 1e-6)
    sized = sized.where(F.col("place") < F.col("n") - both + 1)
    sized = sized.select(F.xxhash64("shingle", F.least("class", "other"), F.greatest("class", "other")).alias("group"), "id", "component", "class", (F.col("class") == F.col("other")).alias("alike"))
    both = sized.groupBy("group").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("class").alias("least"), F.max("class").alias("most"), F.first("alike").alias("same"))
    return sized.select("group", "id", "component").join(both.where("x < y AND (same OR least < most)").select("group"), "group")


def _remainder(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components, for all similar pairs of rows (id, component, shingles)."""
    groups = stored(_prefixes(rows, threshold))
    sizes = stored(groups.groupBy("group").agg(F.count("*").alias("size")))
    few = groups.join(sizes.where(F.col("size") <= FEW), "group").select("group", "id", "component")
    other = few.select("group", F.col("id").alias("b"), F.col("component").alias("its"))
    pairs = few.join(other, "group").where("id < b AND component <> its").select(F.col("id").alias("a"), "b").distinct()
    many = groups.join(sizes.where(F.col("size") > FEW), "group").select(F.col("group").alias("cluster"), "id", "component")
    pairs = pairs.union(_across(many, sets, threshold).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    return _verified(stored(pairs), sets, threshold)


def _across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components of one cluster that may be linked, found by comparison in blocks.

    Of a shingle's hash its high 32 bits are sent, so a pair may seem more alike than it is, never less.
    members: id, component and cluster. In each cluster, all rows outside its largest component
    are compared with all rows of other components. Both sides are dealt into blocks of about
    BLOCK rows, and each pair of blocks is one group. A row gives one link to each component.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    clusters = stored(sizes.groupBy("cluster").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1"))
    short = sets.select("id", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("shingles"))
    rows = members.join(clusters, "cluster")
    few = F.col("rows") - F.col("top.n")
    grid = rows.select(
        "id", "component", "cluster", (F.col("component") != F.col("top.component")).alias("asks"),
        F.ceil(F.col("rows") / BLOCK).cast("int").alias("columns"), F.ceil(few / BLOCK).cast("int").alias("lines"),
    )
    own = F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")
    line = F.pmod(F.xxhash64("id", F.lit(7)), F.col("lines")).cast("int")
    told = grid.select("id", "component", "cluster", F.lit(False).alias("asks"), own.alias("column"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"))
    asks = grid.where("asks").select("id", "component", "cluster", "asks", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), line.alias("line"))

    def run(group: pa.Table) -> pa.Table:
        asking = group.column("asks").to_numpy().astype(bool)
        ids, comps = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets_ = [np.asarray(x.values) for x in group.column("shingles")]
        at = np.flatnonzero(~asking)
        owner = np.repeat(np.arange(len(at)), [len(sets_[i]) for i in at])
        flat = np.concatenate([sets_[i] for i in at]) if len(at) else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        size, other = np.array([len(sets_[i]) for i in at]), comps[at]
        a, b = [], []
        for i in np.flatnonzero(asking):
            own_set = sets_[i]
            low, high = np.searchsorted(flat, own_set, "left"), np.searchsorted(flat, own_set, "right")
            n = high - low
            places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[places], minlength=len(at))
            good = np.flatnonzero((both * 100 >= round(threshold * 100) * (size + len(own_set) - both)) & (other != comps[i]))
            good = good[np.argsort(-both[good], kind="stable")]
            for k in good[np.unique(other[good], return_index=True)[1]]:
                a.append(int(ids[i])), b.append(int(ids[at[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return told.union(asks).join(short, "id").groupBy("cluster", "column", "line").applyInArrow(run, "a long, b long")


def _with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and component of nodes (id), by links (a, b)."""
    return nodes.join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, words_each: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept for every document.

    A-Z are lower-cased and words are runs of bytes other than ASCII white space. A document's
    set holds its distinct shingles of words_each words; with fewer words, the whole sequence
    is one shingle; without words (or text) it is empty, and linked with nothing. Documents are
    linked when their sets' Jaccard similarity is at least threshold, confirmed on full sets.
    component_id is the least id reachable and kept marks the row that bears it. Rows that
    repeat an id share its fate, that of the least of their sets in order where their texts differ; a row with a null id teaches nothing and keeps a null component.

    Documents of equal sets count once. In each tree of the forest, a region is what shares a first key; large regions
    are parted by longer prefixes until they are small. A document is compared with the hub of each of its regions and parts
    (the document that shares most regions) and with its neighbours in the sorted order, which share the longest prefixes.
    Where a region still holds several components, all its documents go on: of these, the similar pairs of
    different components are found exactly, by their rarest shingles.
    """
    made = stored(signatures(docs, words_each, id_col, text_col))
    classes = stored(made.where("n > 0").groupBy("set_low", "set_high").agg(F.min("id").alias("id")))
    firsts = made.join(classes.select("id"), "id", "left_semi").where("n > 0")
    rows = firsts.select("id", F.explode(F.arrays_zip("shallow", "deep")).alias("x")).select(F.col("x.shallow").alias("key"), F.col("x.deep").alias("deep"), "id")
    regions = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stored(rows.join(regions, "key"))
    shared = stored(shared.join(shared.groupBy("id").agg(F.sum("n").alias("fame")), "id"))

    levels = _levels(shared)
    hubs = stored(levels.groupBy("key").agg(F.max(F.struct("fame", (-F.col("id")).alias("id"))).alias("hub")).select("key", (-F.col("hub.id")).alias("hub")))
    to_hubs = stored(levels.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    involved = stored(shared.select("id").distinct())
    sets = stored(shingle_table(docs.join(involved.select(F.col("id").alias(id_col)).hint("shuffle_hash"), id_col, "left_semi"), words_each, id_col, text_col).groupBy("id").agg(F.min("shingles").alias("shingles")))
    links = stored(_verified(to_hubs, sets, threshold))
    nodes = stored(_with_components(involved, links))

    beside = _predecessors(shared).distinct()
    for side in ("a", "b"):
        beside = beside.join(nodes.select(F.col("id").alias(side), F.col("component").alias(f"component_{side}")), side)
    beside = stored(_verified(stored(beside.where("component_a <> component_b").select("a", "b")), sets, threshold))
    links = links.union(beside)
    nodes = stored(_with_components(involved, links))

    open_keys = shared.join(nodes, "id").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    waiting = shared.join(open_keys, "key").select("id").distinct()
    found = components(stored(links.union(_remainder(stored(nodes.join(waiting, "id").join(sets, "id")), sets, threshold))))

    known = stored(classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_low", "set_high", F.coalesce("component", "id").alias("component")))
    discard(regions, shared, hubs, to_hubs, involved, sets, beside)
    out = made.select("id", "n", "set_low", "set_high").join(known, ["set_low", "set_high"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=2)


OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT s, count(*) AS c FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.s, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.c, g.s) AS k FROM g JOIN f USING (s) JOIN n USING (doc_id)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id
  WHERE x.k <= x.n - ceil(0.8 * x.n) + 1 AND y.k <= y.n - ceil(0.8 * y.n) + 1),
i AS (SELECT p.a, p.b, count(*) AS i FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b AND y.s = x.s GROUP BY p.a, p.b),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.i >= 80 * (x.n + y.n - i.i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS b FROM c GROUP BY a) m USING (doc_id)
"""
