"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._components import components
from tidemill.llm._spark import stored, table
from tidemill.llm._words import mix

#: Directions of one coarse hash, of which a vector takes the nearest with its sign.
FAN = 16
#: Vectors that a coarse cell should hold on average, and rows of either side in one block.
CELL, BLOCK = 48, 1024
#: Pairs, times lines, whose collisions are counted at once.
AT_ONCE = 1 << 20
#: Projections whose collisions are counted, and the share of them in which a pair at the threshold collides.
LINES, HIT = 32, 0.9


class Plan:
    """Directions for vectors of one length, with counts that meet the recall wanted at the threshold."""

    def __init__(self, size: int, depth: int, threshold: float, recall: float) -> None:
        rng = np.random.default_rng([size, depth, 77])
        apart = math.sqrt(max(2 - 2 * threshold, 1e-12))
        # pairs at the threshold, to see how often one coarse hash keeps them together
        x, z = rng.normal(size=(2, 4000, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
        trial = rng.normal(size=(8, size, FAN))
        same = np.mean([(_nearest(x @ d) == _nearest(y @ d)).mean() for d in trial])
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same**depth, 0.999999))))
        self.coarse = rng.normal(size=(self.tables, depth, size, FAN))
        self.lines = rng.normal(size=(size, LINES))
        # a pair at the threshold collides on a line with chance HIT; the count that all but 1 - recall of such pairs reach
        self.window = apart * 1.6448536269514722 if HIT == 0.9 else apart * _normal_bound(HIT)
        chance = [math.comb(LINES, k) * HIT**k * (1 - HIT) ** (LINES - k) for k in range(LINES + 1)]
        self.count = max(k for k in range(LINES + 1) if sum(chance[k:]) >= recall)

    def cells(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """Coarse cell of each vector in each table, or in the first few."""
        tables = self.tables if tables is None else tables
        coarse = self.coarse[:tables]
        projected = unit @ coarse.transpose(2, 0, 1, 3).reshape(unit.shape[1], -1)
        nearest = _nearest(projected.reshape(-1, FAN)).astype(np.uint64).reshape(len(unit), tables, -1)
        code = np.tile(np.arange(tables, dtype=np.uint64), (len(unit), 1))
        for d in range(nearest.shape[2]):
            code = code * np.uint64(2 * FAN) + nearest[:, :, d]
        return mix(code + np.uint64(unit.shape[1] << 48)).view(np.int64)


def _normal_bound(share: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf((1 + share) / 2)


def _nearest(projected: np.ndarray) -> np.ndarray:
    best = np.abs(projected).argmax(1)
    return 2 * best + (projected[np.arange(len(projected)), best] < 0)


@lru_cache(maxsize=16)
def _plan(size: int, depth: int, threshold: float, recall: float) -> Plan:
    return Plan(size, depth, threshold, recall)


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in column.to_numpy(zero_copy_only=False)]


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def collisions(asking: np.ndarray, told: np.ndarray, window: float) -> np.ndarray:
    """On how many lines each of told lies within the window around each of asking: both by row, lines by column.

    Sorted lines are laid behind one another, so that several are searched at once.
    """
    pairs, counts = len(asking) * len(told), np.zeros(len(asking) * len(told), np.int64)
    reach = max(np.abs(asking).max(initial=0), np.abs(told).max(initial=0)) + window
    step = max(1, AT_ONCE // max(1, pairs))
    for k in range(0, asking.shape[1], step):
        ask, line = asking[:, k : k + step].T, told[:, k : k + step].T
        order = np.argsort(line, axis=1, kind="stable")
        behind = (2 * reach + 1) * np.arange(len(line))[:, None]
        line = (np.take_along_axis(line, order, 1) + behind).ravel()
        low = np.searchsorted(line, (ask - window + behind).ravel(), "left")
        n = np.searchsorted(line, (ask + window + behind).ravel(), "right") - low
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.tile(np.arange(len(asking)) * len(told), len(ask)), n)
        counts += np.bincount(row + order.ravel()[place], minlength=pairs)
    return counts.reshape(len(asking), len(told))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n by the links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.9995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id and kept for every vector.

    Pairs found with a cosine of at least threshold, in double precision, are linked. Vectors
    that are null, empty or nought, or hold a null or non-finite component, link with
    nothing, nor do vectors of different lengths. Equal vectors are compared once and are linked with
    each other. component_id is the least id reachable, null where only null ids are; kept marks the rows that bear it.
    Ids may be null or repeated: links are those of rows, whatever their ids. Other columns are left out.

    Vectors meet in coarse cells of several tables. In a cell, the projections on LINES random
    lines are sorted, and the pairs within a window around each vector counted over all
    lines; a pair whose count reaches the calibrated one is verified. A pair that meets in
    several cells counts in the first. Cells beyond BLOCK vectors are compared block by block.
    """
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.size(F.filter(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) == 0
    usable = F.coalesce(fit & F.exists(numbers, lambda x: x != 0), F.lit(False))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, numbers).alias("v"))
    keyed = plain.withColumn("key", F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x + 0.0))), "").cast("binary"))))
    made = stored(keyed.select("id", "key", "v"))
    equal = made.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = stored(equal.withColumn("id", F.monotonically_increasing_id()))  # numbers of classes, the same ever after as they are written
    depths = {r["size"]: max(1, round(math.log(max(r["n"] / CELL, 1)) / math.log(2 * FAN))) for r in classes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            sizes = np.array([len(r) for r in rows])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                plan = _plan(size, depths[size], threshold, recall)
                for low in range(0, len(own), 2048):
                    some = own[low : low + 2048]
                    cells = plan.cells(_unit([rows[i] for i in some]))
                    tables = np.tile(np.arange(plan.tables, dtype=np.int32), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], plan.tables)), pa.array(cells.ravel()), pa.array(tables)], names=["id", "cell", "nth"])

    placed = stored(classes.select("id", "v").mapInArrow(place, "id long, cell long, nth int"))
    cells = stored(placed.groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = placed.join(cells, "cell").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    grid = met.select("id", "cell", "nth", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grid = grid.select("id", "cell", "nth", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
        nth, low, high = (group.column(c)[0].as_py() for c in ("nth", "low", "high"))
        weight, rows = group.column("n").to_numpy(), _matrix(group.column("v").combine_chunks())
        sizes = np.array([len(r) for r in rows])
        if len(np.unique(sizes)) > 1:  # two lengths in one cell by chance of the hash
            parts = [compare(group.filter(pa.array(sizes == s))) for s in np.unique(sizes)]
            return pa.concat_tables(parts)
        plan = _plan(int(sizes[0]), depths[int(sizes[0])], threshold, recall)
        unit = _unit(rows)
        lines = unit @ plan.lines
        asks, told = np.flatnonzero(own == low), np.flatnonzero(own == high)
        if not len(asks) or not len(told):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        a, b = np.nonzero(collisions(lines[asks], lines[told], plan.window) >= plan.count)
        a, b = asks[a], told[b]
        once = a < b if low == high else a != b
        a, b = a[once], b[once]
        if nth:
            before = plan.cells(unit, nth)
            apart = np.ones(len(a), bool)
            for t in range(nth):
                apart &= before[a, t] != before[b, t]
            a, b = a[apart], b[apart]
        near = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) >= threshold for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        a, b = a[near], b[near]
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][_roots(len(ids), rank[a], rank[b])][rank]
        out = np.flatnonzero(links > 0)
        return pa.table({"id": ids[out], "links": links[out].astype(np.int64), "root": root[out]})

    pairs = grid.join(classes.select("id", "n", "v"), "id")
    found = stored(pairs.groupBy("cell", "low", "high").applyInArrow(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("key", "id", "n", "least").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    known = stored(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "least"))
    least = stored(known.groupBy("component").agg(F.min("least").alias("component_id")))
    known = stored(known.join(least, "component").select("key", "n_links", "component_id"))
    out = made.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(c.b) AS component_id, vec_id = min(c.b) AS kept
FROM v JOIN c ON c.a = vec_id GROUP BY vec_id
"""
