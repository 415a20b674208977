"""Window frames by groups of peers, and with rows left out, by frames that Spark has; running sums over hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, by: str, order: str, value: str, before: int, after: int, exclude: str = "no others") -> DataFrame:
    """df with frame_sum and frame_count of value over GROUPS BETWEEN before PRECEDING AND after FOLLOWING EXCLUDE exclude.

    exclude is "no others", "current row", "group" or "ties". Groups of peers are numbered by dense rank, and a RANGE frame over
    these numbers is a GROUPS frame. Rows left out are subtracted: the current row itself, or the sums of its peers, which are in the
    frame where before and after aren't negative. Nulls in value don't count; a sum over none is null. Rows of one key are sorted in one task, with spilling.
    """
    if min(before, after) < 0 or exclude not in ("no others", "current row", "group", "ties"):
        raise ValueError("frames reach backward and forward by 0 groups or more, and leave out no others, current row, group or ties")
    numbered = df.withColumn("peers__", F.dense_rank().over(Window.partitionBy(by).orderBy(order)))
    frame, peers = Window.partitionBy(by).orderBy("peers__").rangeBetween(-before, after), Window.partitionBy(by, "peers__")
    total, count = F.coalesce(F.sum(value).over(frame), F.lit(0)), F.count(value).over(frame)
    own, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    if exclude in ("group", "ties"):
        total, count = total - F.coalesce(F.sum(value).over(peers), F.lit(0)), count - F.count(value).over(peers)
    if exclude == "ties":
        total, count = total + own, count + one
    if exclude == "current row":
        total, count = total - own, count - one
    return numbered.withColumn("frame_count", count).withColumn("frame_sum", F.when(F.col("frame_count") > 0, total)).drop("peers__")


def running_sum(df: DataFrame, by: str, on: str, value: str, bucket_seconds: int) -> DataFrame:
    """df with running: the sum of value over the rows of the same key up to this one by time, rows of equal time included.

    Rows are summed within buckets of time, and one row a bucket carries the sum of all earlier ones, so a key that holds much of the
    table is spread over as many tasks as it has buckets. A null value counts as 0.
    """
    bucket = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / (bucket_seconds * 1_000_000))
    rows = df.withColumn("bucket__", bucket)
    within = F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy(by, "bucket__").orderBy(on))
    sums = rows.groupBy(F.col(by).alias("by__"), F.col("bucket__").alias("of__")).agg(F.sum(value).alias("sum__"))
    earlier = F.coalesce(F.sum("sum__").over(Window.partitionBy("by__").orderBy("of__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("by__", "of__", earlier.alias("carried__"))
    both = rows.withColumn("within__", within).join(carried, F.col(by).eqNullSafe(F.col("by__")) & F.col("bucket__").eqNullSafe(F.col("of__")))
    return both.withColumn("running", F.col("within__") + F.col("carried__")).select(*df.columns, "running")
