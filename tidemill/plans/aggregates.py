"""Aggregation and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.frames import groups_frame, running_sum
from tidemill.operators.quantiles import exact_quantiles
from tidemill.sources.tables import load, stored, views


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey", "l_linestatus").alias("pairs"), F.count("*").alias("n"))


def _sql(text: str, *tables: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(text)

    return run


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over part of a group, and a condition on the group."""
    views(spark, sf_dir, "lineitem")
    return spark.sql("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted
        FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20""")


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles: a sketch brackets them, and what lies within the brackets is ranked."""
    got = exact_quantiles(load(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.9])
    return got.select("event_type", F.round(F.col("q")[0], 6).alias("middle"), F.round(F.col("q")[1], 6).alias("high"))


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct values and of the median beside the exact figures, and whether they keep their bounds.

    The sketch of distinct values is off by 2% (one standard deviation), so by 8% almost never; that of the median
    by a rank of one in 10,000.
    """
    events = load(spark, sf_dir, "events").select("event_type", "user_id", "value")
    sketched = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", 0.5, 10000).alias("m"))
    users = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))
    exact = exact_quantiles(events, "event_type", "value", [0.4999, 0.5, 0.5001]).select("event_type", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))
    got = sketched.join(users, "event_type").join(exact, "event_type")
    beside = F.expr("m BETWEEN low AND high OR n < 10000 AND abs(m - middle) <= high - low + 1")
    return got.select("event_type", "users", F.round("middle", 6).alias("middle"), (F.abs(F.col("about") - F.col("users")) <= 0.08 * F.col("users")).alias("users_close"), beside.alias("middle_close"))


def grouping_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their most common status (of equals the first) by priority, by priority and year, and in all, told apart by grouping_id."""
    views(spark, sf_dir, "orders")
    return spark.sql("""SELECT o_orderpriority, year(o_orderdate) AS year, cast(grouping_id() AS int) AS level, mode() WITHIN GROUP (ORDER BY o_orderstatus) AS status, count(*) AS n
        FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))""")


def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the median of values in every stretch of seven days, merged from sketches kept by day, beside the exact figures.

    A day's sketches are of bounded size (2**12 registers; 400 values a level) and are written once; a stretch of days reads seven of them and no
    events. The estimate of users is off by 1.6% (one standard deviation), the median's rank by 1%: within four times that both hold almost surely.
    """
    events = load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "value")
    daily = stored(events.groupBy("day").agg(F.hll_sketch_agg("user_id", 12).alias("users"), F.kll_sketch_agg_double("value", F.lit(400)).alias("values")))
    stretch = F.explode(F.sequence(F.date_sub("day", 6), F.col("day")))
    merged = daily.withColumn("begin", stretch).groupBy("begin").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"), F.kll_merge_agg_double("values").alias("values"))
    exact = events.withColumn("begin", stretch)
    exact = exact.groupBy("begin", "user_id").agg(F.count("*").alias("n")).groupBy("begin").agg(F.count("user_id").alias("users"), F.sum("n").alias("n"))
    got = merged.select("begin", "about", F.kll_sketch_get_quantile_double("values", F.lit(0.5)).alias("m")).join(exact, "begin")
    below = events.withColumn("begin", stretch).join(F.broadcast(got.select("begin", "m")), "begin").groupBy("begin").agg(F.sum((F.col("value") < F.col("m")).cast("long")).alias("below"), F.sum((F.col("value") <= F.col("m")).cast("long")).alias("upto"))
    got = got.join(below, "begin")
    reach = 0.04 * F.col("n") + 1
    return got.select("begin", "n", "users", (F.abs(F.col("about") - F.col("users")) <= 0.07 * F.col("users") + 1).alias("users_close"), ((F.col("below") <= 0.5 * F.col("n") + reach) & (F.col("upto") >= 0.5 * F.col("n") - reach)).alias("middle_close"))


def group_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the day before, the same day and the day after on which a user did something, with and without the row itself, its day, and the others of its day."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    for k, exclude in enumerate(("no others", "current row", "group", "ties")):
        events = groups_frame(events, "user_id", "day", "value", 1, 1, exclude).withColumnsRenamed({"frame_sum": f"sum_{k}", "frame_count": f"n_{k}"})
    return events.select("event_id", *[F.round(f"sum_{k}", 4).alias(f"sum_{k}") for k in range(4)], *[f"n_{k}" for k in range(4)])


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of event has come to so far; each kind is spread over the days."""
    got = running_sum(load(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value", 86400)
    return got.select("event_id", F.round("running", 3).alias("running"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql("SELECT user_id, listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type) AS kinds FROM events GROUP BY user_id")


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0, kinds)


def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax")).unpivot("l_returnflag", ["quantity", "discount", "tax"], "measure", "most")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.stddev("l_quantity"), 6).alias("deviation"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.covar_pop("l_discount", "l_tax"), 9).alias("covariance"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")).alias("dearest"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    by_status = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("nth"), F.rank().over(by_status).alias("rank"), F.dense_rank().over(by_status).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("percent"),
        F.round(F.cume_dist().over(w), 6).alias("share"), F.ntile(4).over(w).alias("quarter"),
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("event_id").over(whole).alias("first"), F.last("event_id").over(whole).alias("last"), F.nth_value("event_id", 3).over(whole).alias("third"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the last three rows and over the last day."""
    views(spark, sf_dir, "events")
    return spark.sql("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")


def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users in batch: a pause of six hours begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    marked = load(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


_SETS = "SELECT event_type, user_id % 7 AS bin, grouping(event_type)::INT AS g, count(*) AS n FROM events GROUP BY {}"

QUERIES = {
    "distinct_counts": distinct_counts,
    "grouping_sets": _sql(_SETS.replace("::INT", "").replace("grouping(event_type)", "cast(grouping(event_type) AS int)").format("GROUPING SETS ((event_type), (user_id % 7), ())"), "events"),
    "cube": _sql(_SETS.replace("::INT", "").replace("grouping(event_type)", "cast(grouping(event_type) AS int)").format("CUBE (event_type, user_id % 7)"), "events"),
    "rollup": _sql(_SETS.replace("::INT", "").replace("grouping(event_type)", "cast(grouping(event_type) AS int)").format("ROLLUP (event_type, user_id % 7)"), "events"),
    "filtered_aggregates": filtered, "quantiles": quantiles, "approximate": approximate, "string_aggregates": strings, "pivot": pivot, "unpivot": unpivot, "moments": moments,
    "ranks": ranks, "neighbours": neighbours, "frames": frames, "sessionized": sessionized,
    "grouping_ids": grouping_ids, "stored_sketches": stored_sketches, "group_frames": group_frames, "running_totals": running_totals,
}

SQL = {
    "distinct_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linestatus)) AS pairs, count(*) AS n FROM lineitem GROUP BY ALL",
    "grouping_sets": _SETS.format("GROUPING SETS ((event_type), (bin), ())"),
    "cube": _SETS.format("CUBE (event_type, bin)"),
    "rollup": _SETS.format("ROLLUP (event_type, bin)"),
    "filtered_aggregates": """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted
        FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20""",
    "quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY event_type",
    "approximate": "SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS middle, true AS users_close, true AS middle_close FROM events GROUP BY event_type",
    "string_aggregates": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    "pivot": """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
        count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id""",
    "unpivot": """WITH m AS (SELECT l_returnflag, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, 'quantity' AS measure, q AS most FROM m UNION ALL SELECT l_returnflag, 'discount', d FROM m UNION ALL SELECT l_returnflag, 'tax', t FROM m""",
    "moments": """SELECT l_linestatus, round(stddev(l_quantity), 6) AS deviation, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(covar_pop(l_discount, l_tax), 9) AS covariance,
        max((l_extendedprice, l_orderkey, l_linenumber, l_partkey))[4] AS dearest FROM lineitem GROUP BY ALL""",
    "ranks": """SELECT o_orderkey, row_number() OVER w AS nth, rank() OVER s AS rank, dense_rank() OVER s AS dense, round(percent_rank() OVER w, 6) AS percent, round(cume_dist() OVER w, 6) AS share,
        ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), s AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""",
    "neighbours": """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_id) OVER a AS first, last_value(event_id) OVER a AS last, nth_value(event_id, 3) OVER a AS third
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "frames": """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""",
    "grouping_ids": """WITH o AS (SELECT o_orderpriority, year(o_orderdate)::INT AS year, o_orderstatus FROM orders),
        c AS (SELECT o_orderpriority, year, o_orderstatus, grouping(o_orderpriority, year)::INT AS level, count(*) AS n FROM o GROUP BY GROUPING SETS ((o_orderpriority, year, o_orderstatus), (o_orderpriority, o_orderstatus), (o_orderstatus)))
        SELECT o_orderpriority, year, level, arg_max(o_orderstatus, n * 1000 - ascii(o_orderstatus)) AS status, sum(n)::BIGINT AS n FROM c GROUP BY ALL""",
    "stored_sketches": """WITH d AS (SELECT unnest(generate_series(ts::DATE - 6, ts::DATE, INTERVAL 1 DAY))::DATE AS begin, user_id FROM events)
        SELECT begin, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS middle_close FROM d GROUP BY begin""",
    "group_frames": "SELECT event_id, " + ", ".join(f"round(sum(value) OVER ({f}), 4) AS sum_{k}, count(value) OVER ({f}) AS n_{k}" for k, f in enumerate(f"PARTITION BY user_id ORDER BY ts::DATE GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {x}" for x in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES"))) + " FROM events",
    "running_totals": "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts), 3) AS running FROM events",
    "sessionized": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, (sum(new) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(ts) AS begin, max(ts) AS "end" FROM s GROUP BY ALL""",
}
