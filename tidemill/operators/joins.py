"""As-of, interval and salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: dict[str, str], bucket_seconds: int | None = None) -> DataFrame:
    """left with columns of the last row of right at or before each left row, within `by`.

    take maps columns of right to their new names. Both sides are put in one sorted run per
    key, so it costs one exchange and one sort and no pair is ever built. Left rows without
    an earlier right row have nulls. Without bucket_seconds the rows of one key are sorted in one task, with spilling; with it, a run is that of a
    key within a bucket of so many seconds, and the last right row of the buckets before comes along by a window over one row a bucket, so a hot key is spread over its buckets.
    """
    right_row = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    kept = F.struct(*[F.col(c) for c in left.columns])
    shape = left.limit(0).select(kept.alias("left__")).schema["left__"].dataType
    told = right.limit(0).select(right_row.alias("right__")).schema["right__"].dataType
    both = left.select(F.col(by).alias("by__"), F.col(left_on).alias("at__"), F.lit(1).alias("side__"), kept.alias("left__"), F.lit(None).cast(told).alias("right__")).union(
        right.select(F.col(by), F.col(right_on), F.lit(0), F.lit(None).cast(shape), right_row)
    )
    keys = ["by__"]
    if bucket_seconds:
        keys.append("bucket__")
        both = both.withColumn("bucket__", F.floor(F.unix_micros(F.col("at__").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    run = Window.partitionBy(*keys).orderBy("at__", "side__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("right__", F.last("right__", ignorenulls=True).over(run))
    if bucket_seconds:
        last = both.groupBy(*keys).agg(F.max_by("right__", F.when(F.col("side__") == 0, F.col("at__"))).alias("last__"))
        before = Window.partitionBy("by__").orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(F.col("by__").alias("of__"), F.col("bucket__").alias("in__"), F.last("last__", ignorenulls=True).over(before).alias("carried__"))
        met = seen.where("side__ = 1").join(carried, F.col("by__").eqNullSafe(F.col("of__")) & F.col("bucket__").eqNullSafe(F.col("in__")))
        seen = met.withColumn("right__", F.coalesce("right__", "carried__"))
    return seen.where("side__ = 1").select("left__.*", *[F.col(f"right__.{n}").alias(n) for n in take.values()])


def interval_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, seconds: int, prefix: str = "r_") -> DataFrame:
    """Pairs of one key whose right time lies in [left, left + seconds].

    Times are cut into buckets as long as the interval, so a left row meets two buckets of
    right at most; the equi-join on key and bucket replaces a scan of all pairs of a key.
    Columns of right get prefix.
    """
    def seconds_of(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    width = seconds * 1_000_000
    first = F.floor(seconds_of(left_on) / width)
    spread = left.withColumn("bucket__", F.explode(F.array(first, first + 1)))
    told = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("bucket__", F.floor(seconds_of(prefix + right_on) / width))
    met = spread.join(told, (spread[by] == told[prefix + by]) & (spread["bucket__"] == told["bucket__"]))
    gap = seconds_of(prefix + right_on) - seconds_of(left_on)
    return met.where(gap.between(0, width)).drop("bucket__")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int) -> DataFrame:
    """Inner join where a key may hold much of left: left rows are dealt to `salts` parts, right rows copied to each.

    Both sides are sorted and merged: Spark takes the copies to be as small as right itself, and would send them all to the driver and each executor.
    """
    dealt = left.withColumn("salt__", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copied = right.withColumn("salt__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied.hint("merge"), [on, "salt__"]).drop("salt__")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of a group per task before the exchange."""
    ranked = df.withColumn("rank__", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank__") <= n).drop("rank__")
