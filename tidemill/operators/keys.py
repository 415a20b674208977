"""Joins with keys of very uneven weight, on hashes of what is compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import stored

#: A key with one of so many parts of all weight is heavy; there are fewer heavy keys than this.
HEAVY_PARTS = 1000


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits, which together stand for the values."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def weighted_join(left: DataFrame, right: DataFrame, weight: str) -> DataFrame:
    """Left join on the hashes h1 and h2, where right has one row for each key and `weight` tells how many rows of left it meets.

    Keys with a thousandth of all weight or more, of which there are a thousand at most, are sent to all tasks. Rows
    of left with such a key take part in the other join under a hash of their own that meets nothing, so no task gets more than about a
    thousandth of left for one key. Columns of right other than the hashes must have names of their own.
    """
    right = stored(right)
    total = right.agg(F.sum(weight)).first()[0] or 0
    told = [c for c in right.columns if c not in ("h1", "h2")]
    heavy = right.where(F.col(weight) * HEAVY_PARTS >= total).select(F.col("h1").alias("x1__"), F.col("h2").alias("x2__"), F.struct(*told).alias("heavy__"))
    light = right.where(F.col(weight) * HEAVY_PARTS < total).select(F.col("h1").alias("y1__"), F.col("h2").alias("y2__"), F.struct(*told).alias("light__"))
    first = left.join(F.broadcast(heavy), (F.col("h1") == F.col("x1__")) & (F.col("h2") == F.col("x2__")), "left").drop("x1__", "x2__")
    own = F.when(F.col("heavy__").isNull(), F.col("h1")).otherwise(F.xxhash64(*left.columns))
    both = first.withColumn("own__", own).join(light, (F.col("own__") == F.col("y1__")) & (F.col("h2") == F.col("y2__")), "left")
    known = F.coalesce("heavy__", "light__")
    return both.select(*left.columns, *[known[c].alias(c) for c in told])
