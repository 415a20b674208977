"""Pairs of intervals that overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, by: str, begin: str, end: str, prefix: str = "r_") -> DataFrame:
    """Pairs of one key whose intervals [begin, end) have a moment in common; columns of right get prefix. Intervals that are null or not longer than nothing meet none.

    An interval's class is the least power of two (microseconds) that is not below its length. It touches two bins at most as wide as its
    class or a longer one. The longer of two intervals lies in the bins of its own class, the shorter is copied to the
    bins of all classes that the other side has, so that an interval of years costs two rows like one of seconds. A pair meets in
    the bin where the later of them begins, and nowhere else.
    """
    def told(df: DataFrame, side: str) -> DataFrame:
        b, e = (F.unix_micros(F.col(c).cast("timestamp")) for c in (begin, end))
        rows = df.select(F.col(by).alias(f"{side}by"), b.alias(f"{side}b"), e.alias(f"{side}e"), F.struct(*df.columns).alias(f"{side}row")).where(f"{side}by IS NOT NULL AND {side}b < {side}e")
        size = F.col(f"{side}e") - F.col(f"{side}b")
        return rows.withColumn(f"{side}class", reduce(lambda done, k: done + (size > F.lit(1 << k)).cast("int"), range(62), F.lit(0)))

    a, z = told(left, "l"), told(right, "r")
    classes = {side: sorted(r[0] for r in df.select(f"{side}class").distinct().collect()) for side, df in (("l", a), ("r", z))}  # 63 numbers at most

    def bins(df: DataFrame, side: str, level: Column) -> DataFrame:
        low, high = (F.call_function("shiftright", F.col(f"{side}{c}") - F.lit(int(c == "e")), level) for c in "be")
        return df.withColumn("bin", F.explode(F.sequence(low, high)))

    def copied(df: DataFrame, side: str, to: list[int], least: Column) -> DataFrame:
        levels = F.filter(F.array(*[F.lit(k) for k in to]).cast("array<int>"), lambda k: k >= least)
        return bins(df.withColumn("level", F.explode(levels)), side, F.col("level"))

    pairs = []
    for own, other, strict in (("l", "r", 0), ("r", "l", 1)):  # the longer side, the shorter side; equal classes count once
        longer, shorter = (a, z) if own == "l" else (z, a)
        longer = bins(longer.withColumn("level", F.col(f"{own}class")), own, F.col("level")).withColumnsRenamed({"level": "level_", "bin": "bin_"})
        met = longer.join(copied(shorter, other, classes[own], F.col(f"{other}class") + strict), (F.col("lby") == F.col("rby")) & (F.col("level") == F.col("level_")) & (F.col("bin") == F.col("bin_")))
        later = F.call_function("shiftright", F.greatest("lb", "rb"), F.col("level"))
        pairs.append(met.where((F.col("lb") < F.col("re")) & (F.col("rb") < F.col("le")) & (later == F.col("bin"))).select("lrow", "rrow"))
    return pairs[0].union(pairs[1]).select("lrow.*", *[F.col(f"rrow.{c}").alias(prefix + c) for c in right.columns])
