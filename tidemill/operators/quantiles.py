"""Exact quantiles without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import stored


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], accuracy: int = 10000) -> DataFrame:
    """group, n (values that aren't null) and q (array of a value for each of shares), interpolated between neighbours in order; a group of nulls only has n 0 and nulls.

    A sketch of bounded size brackets each quantile. Values below a bracket are only counted; those within, a few in
    `accuracy` of a group's, are counted by value and ranked. Should a bracket not hold its quantile, it is made ten times as wide.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    done, slack, k = None, 3 / accuracy, len(shares)
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in shares]
    while True:
        ends = [[min(1.0, max(0.0, q + sign * slack)) for q in shares] for sign in (-1, 1)]
        low, high = (F.percentile_approx("v", e, accuracy) for e in ends)
        sketch = rows.groupBy("g").agg(F.count("v").alias("n"), low.alias("low"), high.alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
        few = F.col("n") * slack < 8  # a handful of values: all of them
        sketch = stored(sketch.select("g", "n", *[F.when(few, F.col("least")).otherwise(F.col("low")[i]).alias(f"low{i}") for i in range(k)], *[F.when(few, F.col("most")).otherwise(F.col("high")[i]).alias(f"high{i}") for i in range(k)]))
        met = rows.where("v IS NOT NULL").join(sketch.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
        below = met.groupBy("g").agg(*[F.sum((F.col("v") < F.col(f"low{i}")).cast("long")).alias(f"b{i}") for i in range(k)])
        within = F.array(*[F.when(F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}")), F.lit(i)) for i in range(k)])
        inside = met.select("g", "v", F.explode(F.array_compact(within)).alias("i")).groupBy("g", "i", "v").agg(F.count("*").alias("c"))
        ranked = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        known = sketch.join(below.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").select("g", "n", F.array(*[F.col(f"b{i}") for i in range(k)]).alias("b"), F.array(*places).alias("place"))
        both = ranked.join(known.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).withColumn("at", F.get("place", F.col("i"))).withColumn("upto", F.col("upto") + F.get("b", F.col("i")))
        fits = F.get("b", F.col("i")) <= F.floor("at")
        found = both.groupBy("g", "i").agg(F.first("at").alias("at"), F.min(F.when(fits & (F.col("upto") > F.floor("at")), F.col("v"))).alias("a"), F.min(F.when(fits & (F.col("upto") > F.ceil("at")), F.col("v"))).alias("z"))
        each = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q")))).alias("m"))
        out = known.join(each.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left")
        done = stored(out.select(F.col("g").alias(group), "n", F.array(*[F.try_element_at("m", F.lit(i)) for i in range(k)]).alias("q")))
        if slack >= 1 or done.where(F.col("n") > 0).where(F.exists("q", lambda x: x.isNull())).isEmpty():
            return done
        slack *= 10
