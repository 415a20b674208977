"""Short codes for vectors: the nearest codebook entry of each part, found by trees of vantage points in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._spark import stored, table

#: Components up to this are held as they are, and squared distances of whole vectors must surely stay below MOST.
LARGEST, MOST = 1 << 30, 1 << 62


def _squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = rows - entry
    return np.einsum("ij,ij->i", away, away)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of whole numbers, rounded down and rounded up."""
    low = np.sqrt(squares.astype(float)).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


class Node:
    """An entry and two sides: the nearer and the farther half of the entries below, each with its least and greatest distance, rounded outwards."""

    def __init__(self, entries: np.ndarray, members: np.ndarray) -> None:
        self.entry = int(members[0])
        away = _squares(entries[members[1:]], entries[self.entry])
        order = np.argsort(away, kind="stable")
        down, up = _roots(away)
        halves = [h for h in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]) if len(h)]
        self.sides = [(Node(entries, members[1:][h]), int(down[h].min()), int(up[h].max())) for h in halves]


class Search:
    """The nearest of some entries for many rows at once, by branch and bound; of equally near entries the first."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.top = entries, Node(entries, np.arange(len(entries)))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its entry's place and its squared distance."""
        best, place = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)

        def look(node: Node, some: np.ndarray) -> list[tuple[Node, np.ndarray]]:
            """Hold rows against a node's entry; for each side the least distance that its entries can have."""
            squares = _squares(rows[some], self.entries[node.entry])
            better = (squares < best[some]) | ((squares == best[some]) & (node.entry < place[some]))
            best[some[better]], place[some[better]] = squares[better], node.entry
            down, up = _roots(squares)
            return [(side, np.maximum(np.maximum(down - high, low - up), 0)) for side, low, high in node.sides]

        # first straight down the nearer sides, so that most other sides can be left out
        down = [(self.top, np.arange(len(rows)))]
        while down:
            node, some = down.pop()
            sides = look(node, some)
            if sides:
                nearer = np.argmin([b for _, b in sides], axis=0)
                down += [(side, some[nearer == k]) for k, (side, _) in enumerate(sides) if (nearer == k).any()]
        # then wherever an entry as near as the best may lie, equally near ones included
        open_ = [(self.top, np.arange(len(rows)))]
        while open_:
            node, some = open_.pop()
            for side, bound in look(node, some):
                if len(left := some[bound * bound <= best[some]]):
                    open_.append((side, left))
        return place, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows by part by component."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, -1) if n else np.zeros((0, parts, 1), np.int64)


class Codes:
    """rows: the kept columns, code (array of entries' places, one for each part) and error (long); books: part by entry by component."""

    def __init__(self, rows: DataFrame, books: np.ndarray) -> None:
        self.rows, self.books = rows, books


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> Codes:
    """Codes of all vectors, by codebooks fitted to all of them.

    Vectors that are null or hold a null or non-finite component are left out. A component x becomes floor(scale * x).
    Vectors are cut into equal parts; a part's codebook begins with the parts of the smallest ids (null ids last, equal
    ids by components; fewer vectors give fewer entries), and each round replaces an entry by the floor of the mean of the parts nearest to it; an entry
    nearest to none stays. error is the sum of squared distances. All sums are of whole numbers, so nothing depends on how Spark deals the rows out.
    Repeated rows count each time; an empty table gives no rows and no entries. Vectors of several lengths, a length that
    parts doesn't divide, or components so large that a vector's error might not fit a long raise ValueError.

    Each round is one pass: a task returns counts and sums by entry, never rows. The codebooks, of fixed size, go to all tasks.
    """
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = F.greatest(F.lit(0.0), F.array_max(F.transform(numbers, lambda x: F.abs(F.floor(scale * x)).cast("double"))))
    plain = vectors.where(usable).select(F.col(id_col).alias("id"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), numbers.alias("v"), wide.alias("wide"))
    held = F.transform("v", lambda x: F.when(F.col("wide") <= LARGEST, F.floor(scale * x)).cast("int"))
    made = stored(plain.select("id", "kept", "wide", held.alias("v")))
    size, other, wide_most = made.agg(F.min(F.size("v")), F.max(F.size("v")), F.max("wide")).first()
    if size is not None and (size != other or size % parts):
        raise ValueError(f"vectors must be of one length that {parts} divides, not of {size} to {other}")
    if wide_most is not None and (2 * wide_most) ** 2 * size >= MOST:
        raise ValueError(f"a component is {wide_most:.0f} after scaling, too much for the errors of {size} components to fit a long")
    first = made.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    width = (size or 0) // parts
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    for _ in range(rounds if len(first) and width else 0):
        now = books

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = [Search(book) for book in now]
            totals, counts = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                rows = _matrix(batch.column(0), parts)
                for k, search in enumerate(searches):
                    place, _ = search.nearest(rows[:, k])
                    counts[k] += np.bincount(place, minlength=now.shape[1])
                    for e in np.unique(place):
                        totals[k, e] += rows[place == e, k].sum(0)
            cell = np.arange(totals.size)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(counts.ravel(), width)), pa.array(totals.ravel())], names=["cell", "n", "total"])

        sums = made.select("v").mapInArrow(gather, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in sums.where("n > 0").collect():  # parts * entries * width numbers, whatever the table's size
            books.reshape(-1)[r["cell"]] = int(r["total"]) // r["n"]

    kinds = vectors.select(*keep).schema
    shape = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kinds)])
    final = books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in final] if final.shape[1] else []
        for batch in batches:
            rows = _matrix(batch.column(1), parts) if width else np.zeros((batch.num_rows, parts, 0), np.int64)
            found = [search.nearest(rows[:, k]) for k, search in enumerate(searches)]
            codes = np.stack([p for p, _ in found], 1).astype(np.int16)
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), code, pa.array(np.sum([d for _, d in found], 0))], names=["kept", "code", "error"])

    out = T.StructType([T.StructField("kept", shape), T.StructField("code", T.ArrayType(T.ShortType())), T.StructField("error", T.LongType())])
    rows = stored(made.select("kept", "v").mapInArrow(assign, out))
    return Codes(rows.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "code", "error"), books)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, codes.books.ravel().tolist())).encode()).hexdigest()
    sums = stored(codes.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    code = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    return codes.rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """Each part's nearest entry of book k as distance * 16 + entry, so that the least is the nearest and first."""
    away = "list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, min({away} * 16 + b.entry) AS best FROM p JOIN b{k} b ON b.part = p.part GROUP BY p.vec_id, p.part)"


def _moved(k: int) -> str:
    """Book k + 1: floors of means, entries without parts as they were."""
    return f"""s{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT p.part, a.best % 16 AS entry, unnest(p.q) AS x, generate_subscripts(p.q, 1) AS i FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(c, part * (len(c) // 8) + 1, (part + 1) * (len(c) // 8)) AS q FROM v, range(8) t(part)),
b0 AS MATERIALIZED (SELECT part, entry, q FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 16) USING (vec_id)),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(6))}, {_assigned(6)},
r AS (SELECT vec_id, string_agg(lpad(lower(hex(best % 16)), 2, '0'), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id
"""
