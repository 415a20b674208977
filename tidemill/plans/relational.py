"""Projection, filters, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_join, interval_join, salted_join, top_per_group
from tidemill.operators.overlaps import overlap_join
from tidemill.sources.tables import load, views


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices of line items by flag and status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))
        .orderBy("l_returnflag", "l_linestatus")
    )


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_quantity").cast("int").alias("quantity"), size.alias("size"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("tax"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.where(F.col("p_size").between(5, 25) & F.col("p_brand").like("Brand#1%") & ~F.col("p_type").isin("ECONOMY", "PROMO") & ~F.col("p_name").eqNullSafe(None)).select("p_partkey", "p_name", "p_size")


def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of open orders of one segment, the ten largest."""
    customer = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    joined = items.join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("price"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def nation_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume that suppliers of a nation sell to customers of the same nation, by region."""
    views(spark, sf_dir, "region", "nation", "customer", "supplier", "orders", "lineitem")
    return spark.sql("""
        SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")


def outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and items of each customer, customers without any included, and orders without customers."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    customers = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return customers.join(orders.where("o_custkey % 3 <> 0"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_custkey", "c_mktsegment", "n_orders")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return load(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey")
    return load(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in bands of balance: a join on inequality with a fixed list of bands."""
    bands = spark.createDataFrame([("debt", -1e9, 0.0), ("low", 0.0, 2500.0), ("middle", 2500.0, 6000.0), ("high", 6000.0, 1e9)], "band string, low double, high double")
    met = load(spark, sf_dir, "customer").join(F.broadcast(bands), (F.col("c_acctbal") >= F.col("low")) & (F.col("c_acctbal") < F.col("high")))
    return met.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of the same user at or before each purchase."""
    events = load(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(buys, clicks, "user_id", "ts", "ts", {"event_id": "click_id", "ts": "click_ts"}, bucket_seconds=86400)


def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within six hours after a view of the same user."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views_, buys = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("view", "purchase"))
    return interval_join(views_, buys, "user_id", "ts", "ts", 6 * 3600).select("event_id", "user_id", F.col("r_event_id").alias("purchase_id"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views of one user whose times overlap: each lasts two to the power of a number in its properties, seconds to years."""
    events = load(spark, sf_dir, "events")
    seconds = F.pow(F.lit(2.0), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(26))).cast("long")
    spans = events.select("event_id", "user_id", "event_type", F.col("ts").alias("begin"), (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("end"))
    buys, looks = (spans.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    return overlap_join(buys, looks, "user_id", "begin", "end").select("event_id", "r_event_id")


def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment and nation, each join by a strategy asked for: merged for the two large sides, hashed after an exchange, and nations, 25 at every size, sent to all tasks."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    met = orders.join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).join(customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return met.join(nation.hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum("items").alias("items"))


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by brand, the items of a part dealt to eight parts of the join."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", "l_quantity")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_brand")
    return salted_join(items, parts, "partkey", 8).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance, the negative ones as nulls last, the second hundred."""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return load(spark, sf_dir, "customer").select("c_custkey", balance.alias("balance")).orderBy(F.desc_nulls_last("balance"), "c_custkey").offset(100).limit(100)


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by what they did: union, intersection and differences, with and without repeats."""
    events = load(spark, sf_dir, "events")
    of = {kind: events.where(F.col("event_type") == kind).select("user_id") for kind in ("click", "purchase", "error")}
    sets = {"union": of["click"].unionByName(of["error"]).distinct(), "intersect": of["click"].intersect(of["purchase"]), "intersect_all": of["click"].intersectAll(of["purchase"]), "except": of["click"].subtract(of["error"]), "except_all": of["click"].exceptAll(of["purchase"])}
    out = None
    for name, rows in sets.items():
        part = rows.agg(F.lit(name).alias("operation"), F.count("*").alias("n"), F.sum("user_id").cast("long").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest order of each customer of a segment, by a lateral subquery."""
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("""SELECT c_custkey, t.most FROM customer, LATERAL (SELECT max(o_totalprice) AS most FROM orders WHERE o_custkey = c_custkey) AS t
        WHERE c_mktsegment = 'BUILDING'""")


def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by quarter from 1996 on, quarters without orders included, by a recursive table of dates.

    Orders are counted by quarter first, so the dates meet a row a quarter, by equality.
    """
    views(spark, sf_dir, "orders")
    return spark.sql("""WITH RECURSIVE q(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM q WHERE k < 23),
        d AS (SELECT add_months(DATE'1996-01-01', 3 * k) AS quarter FROM q),
        o AS (SELECT to_date(date_trunc('QUARTER', o_orderdate)) AS quarter, count(o_orderkey) AS n FROM orders WHERE o_orderdate >= DATE'1996-01-01' AND o_orderdate < DATE'2002-01-01' GROUP BY 1)
        SELECT d.quarter, coalesce(o.n, 0) AS n FROM d LEFT JOIN o ON d.quarter = o.quarter""")


def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql("FROM events |> WHERE value > 10 |> AGGREGATE count(*) AS n, max(value) AS most GROUP BY event_type |> WHERE n > 5 |> SELECT event_type, n, most")


QUERIES = {
    "pricing_summary": pricing_summary, "projection": projection, "filters": filters, "shipping_priority": shipping_priority, "nation_volume": nation_volume,
    "outer_joins": outer_joins, "semi_join": semi_join, "anti_join": anti_join, "band_join": band_join, "asof_join": asof, "interval_join": interval, "overlap_join": overlaps, "join_hints": join_hints, "salted_join": salted,
    "sorting": sorting, "top_per_group": top_orders, "set_operations": set_operations, "lateral_subquery": lateral, "recursive_dates": recursive, "piped": piped,
}

SQL = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price,
        round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "projection": """SELECT l_orderkey, floor(l_quantity)::INT AS quantity, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size,
        round(l_extendedprice * l_tax, 4) AS tax FROM lineitem""",
    "filters": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 25 AND p_brand LIKE 'Brand#1%' AND p_type NOT IN ('ECONOMY', 'PROMO') AND p_name IS DISTINCT FROM NULL",
    "shipping_priority": """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "nation_volume": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "outer_joins": """SELECT c_custkey, o_custkey, c_mktsegment, n_orders FROM (SELECT * FROM customer WHERE c_acctbal > 0)
        FULL JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "semi_join": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45) GROUP BY ALL",
    "anti_join": "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "band_join": """SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 6000 THEN 'middle' ELSE 'high' END AS band,
        count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL""",
    "asof_join": """SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "interval_join": """SELECT v.event_id, v.user_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR
        WHERE v.event_type = 'view' AND p.event_type = 'purchase'""",
    "join_hints": """SELECT n_name, c_mktsegment, count(*) AS orders, sum(items)::BIGINT AS items FROM orders JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "overlap_join": """WITH s AS (SELECT *, ts + to_seconds(pow(2, (props->>'$.k')::INT % 26)::BIGINT) AS stop FROM events)
        SELECT p.event_id, v.event_id AS r_event_id FROM s p JOIN s v ON p.user_id = v.user_id AND p.ts < v.stop AND v.ts < p.stop WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "salted_join": "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "sorting": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance DESC NULLS LAST, c_custkey LIMIT 100 OFFSET 100",
    "top_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "set_operations": """WITH c AS (SELECT user_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id FROM events WHERE event_type = 'error'),
        a AS (SELECT 'union' AS operation, user_id FROM (FROM c UNION FROM e) UNION ALL SELECT 'intersect', user_id FROM (FROM c INTERSECT FROM p)
        UNION ALL SELECT 'intersect_all', user_id FROM (FROM c INTERSECT ALL FROM p) UNION ALL SELECT 'except', user_id FROM (FROM c EXCEPT FROM e)
        UNION ALL SELECT 'except_all', user_id FROM (FROM c EXCEPT ALL FROM p))
        SELECT operation, count(user_id) AS n, sum(user_id)::BIGINT AS total FROM (SELECT unnest(['union', 'intersect', 'intersect_all', 'except', 'except_all']) AS operation)
        LEFT JOIN a USING (operation) GROUP BY operation""",
    "lateral_subquery": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE c_mktsegment = 'BUILDING'",
    "recursive_dates": """WITH d AS (SELECT (DATE '1996-01-01' + to_months((3 * k)::INT))::DATE AS low, (DATE '1996-01-01' + to_months((3 * k + 3)::INT))::DATE AS high FROM range(24) t(k))
        SELECT low AS quarter, count(o_orderkey) AS n FROM d LEFT JOIN orders ON o_orderdate >= low AND o_orderdate < high GROUP BY low""",
    "piped": "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 5",
}
