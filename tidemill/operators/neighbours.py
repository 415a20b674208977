"""The vectors most like given ones, behind a coarse index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import stored

#: Vectors that the cells are fitted to, at most; cells, at most; and vectors of a cell, or queries, that meet in one task.
FIT, CELLS, BLOCK = 16384, 2048, 4096
#: Cosines are compared when rounded to so many decimals; equal ones stand by id.
DECIMALS = 9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """Directions, and for each the widest angle of a vector that is nearest to it."""

    def __init__(self, centres: np.ndarray, widest: np.ndarray | None = None) -> None:
        self.centres, self.widest = centres, widest

    @classmethod
    def fitted(cls, sample: np.ndarray, count: int, rounds: int = 8) -> Cells:
        """By a few rounds of means over unit vectors, begun with vectors spread evenly over the sample."""
        centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
        for _ in range(rounds):
            own = cls(centres).nearest(sample)[0]
            order = np.argsort(own, kind="stable")
            used, begin = np.unique(own[order], return_index=True)
            means = np.add.reduceat(sample[order], begin)
            size = np.linalg.norm(means, axis=1)
            centres = centres.copy()
            centres[used[size > 0]] = means[size > 0] / size[size > 0, None]
        return cls(centres)

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = units @ self.centres.T
        own = cosines.argmax(1)
        return own, cosines[np.arange(len(units)), own]

    def probes(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Cells that a vector must meet, nearest first, to meet the wanted share of its k nearest in the sample."""
        asks = np.linspace(0, len(sample) - 1, min(512, len(sample))).astype(int)
        cosines = sample[asks] @ sample.T
        cosines[np.arange(len(asks)), asks] = -2
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1
        own = self.nearest(sample)[0][np.argpartition(-cosines, k - 1, axis=1)[:, :k]]
        rank = np.argsort(np.argsort(-(sample[asks] @ self.centres.T), axis=1), axis=1)
        met = np.sort(np.take_along_axis(rank, own, 1).ravel())
        return int(met[math.ceil(recall * len(met)) - 1]) + 1

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """For each vector and cell the largest cosine that a vector of the cell can have with it; a little is added for rounding."""
        apart = np.arccos(np.clip(units @ self.centres.T, -1, 1)) - self.widest
        return np.cos(np.maximum(apart - 1e-6, 0)) + 1e-9


def _best(cosines: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, of equal ones the least ids; ids ascend, and -2 counts as nothing."""
    if cosines.shape[1] > k:
        least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((cosines >= least) & (cosines > -2))
    else:
        rows, columns = np.nonzero(cosines > -2)
    order = np.lexsort((ids[columns], -cosines[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[nth < k], columns[nth < k]


def _units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(numbers, lambda x: x != 0)
    most = F.array_max(F.transform(numbers, F.abs))
    rows = vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(numbers, lambda x: x / most).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", F.transform("v", lambda x: x / size).alias("v"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and cosine of the k vectors most like each query, but for the one of the query's own id.

    Vectors fall into cells by the nearest of some directions, fitted to FIT of them at most, drawn by a hash of their ids; every
    vector is in a cell. A query meets as many of the cells nearest to it as hold the wanted share (`recall`) of the k nearest
    of the fitted vectors among themselves; in the whole, denser table the k nearest are nearer still. With exact, it then meets each other cell
    that can hold a vector as like as its k-th so far, by the cell's widest angle, so nothing is missed.
    In a task, queries meet a block of a cell; the k best of each query go on, and are merged by rank.
    Of cosines equal to DECIMALS decimals the least ids come first.

    Null ids, and vectors that are null, nought or hold a null or non-finite component, find and are found by nothing. Ids must be keys and
    vectors of one length. Neither queries nor vectors are gathered anywhere: a task holds BLOCK of both at most.
    """
    spark = vectors.sparkSession
    told, asked = stored(_units(vectors, id_col, vector_col)), stored(_units(queries, id_col, vector_col))
    n, size, most_size = told.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    shape = "query_id long, vec_id long, cosine double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, cosine double")
    if size != most_size:
        raise ValueError(f"vectors must be of one length, not of {size} to {most_size}")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT * 0.8 / n))
    sample = np.array([r["v"] for r in told.where(share).orderBy(F.xxhash64("id"), "id").select("v").limit(FIT).collect()] or [told.select("v").first()["v"]])
    cells = Cells.fitted(sample, max(1, min(CELLS, len(sample) // 8, round(4 * math.sqrt(n)))))
    probes = cells.probes(sample, k, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cosine = cells.nearest(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(cosine)], names=["id", "v", "cell", "near"])

    placed = stored(told.mapInArrow(place, "id long, v array<double>, cell int, near double"))
    counted = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()
    widest, blocks = np.full(len(cells.centres), -10.0), np.zeros(len(cells.centres), np.int64)
    for r in counted:  # a row for each cell
        widest[r["cell"]], blocks[r["cell"]] = math.acos(max(-1.0, min(1.0, r["near"]))), -(-r["n"] // BLOCK)
    cells = Cells(cells.centres, widest)
    held = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "cell int, blocks int")
    told = placed.join(F.broadcast(held), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")

    def ask(first: bool):
        """Rows of a query, its vector and what its k-th cosine is so far, to a row for each cell it meets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    bounds = cells.bounds(units := _matrix(part.column(1)))
                    near = np.where(blocks > 0, units @ cells.centres.T, -3)
                    count = min(probes, near.shape[1])
                    chosen = np.zeros(near.shape, bool)
                    np.put_along_axis(chosen, np.argpartition(-near, count - 1, axis=1)[:, :count], True, axis=1)
                    if not first:
                        chosen = ~chosen & (bounds >= part.column(2).to_numpy()[:, None])
                    rows, columns = np.nonzero(chosen & (blocks > 0))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(columns, pa.int32())], names=["id", "v", "cell"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        right = right.sort_by("id")
        asks, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        ours, theirs = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
        found = []
        for low in range(0, len(asks), 256):
            cosines = np.round(ours[low : low + 256] @ theirs.T, DECIMALS)
            cosines[asks[low : low + 256, None] == ids[None]] = -2
            rows, columns = _best(cosines, ids, k)
            found.append((asks[low + rows], ids[columns], cosines[rows, columns]))
        return pa.table({name: pa.array(np.concatenate([f[i] for f in found])) for i, name in enumerate(("query_id", "vec_id", "cosine"))})

    def meet(asking: DataFrame) -> DataFrame:
        """The k best of each query in each block of the cells it meets; both sides of a cell are dealt to blocks."""
        asking = stored(asking)
        sizes = asking.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(F.broadcast(held), "cell")
        sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes.collect()], "cell int, parts int, blocks int"))  # a row for each cell
        left = asking.join(sizes, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = told.join(sizes.drop("blocks"), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block")
        return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(compare, shape)

    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")

    best = stored(merged(meet(asked.mapInArrow(ask(True), "id long, v array<double>, cell int"))))
    if exact:
        last = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("last"))
        open_ = asked.join(last, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("last", F.lit(-2.0)).alias("last"))
        best = merged(best.drop("rank").unionByName(meet(open_.mapInArrow(ask(False), "id long, v array<double>, cell int"))))
    return best


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """queries (that have a true neighbour) and recall: the share of the true neighbours that are found; a neighbour as like as a true one counts as it."""
    last = truth.groupBy("query_id").agg(F.count("*").alias("n"), F.min("cosine").alias("last"))
    hits = found.join(last, "query_id").where(F.col("cosine") >= F.col("last")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return last.join(hits, "query_id", "left").agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).alias("recall"))
