"""Scalar functions, Python functions and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.python import Letters, above_least, extremes, highest, lowest, matched, positive, spread, squash
from tidemill.sources.ranges import register
from tidemill.sources.tables import load, round_trip


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.upper(name).alias("upper"), F.substring(name, 2, 4).alias("part"), F.regexp_replace(name, "[aeiou]", "_").alias("masked"), F.split(name, " ")[0].alias("first"), F.levenshtein(name, F.col("p_type")).alias("distance"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.date_trunc("month", day).cast("timestamp_ntz").alias("month"), F.datediff(F.lit("2002-01-01").cast("date"), day.cast("date")).alias("age"), F.date_format(day, "yyyy-MM-dd").alias("day"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("cast(l_quantity AS bigint) div 3")).alias("thirds"), F.round(F.sum(F.sqrt(price)), 4).alias("roots"), F.sum(F.floor(F.log10(price))).cast("long").alias("digits"), F.sum(F.pmod(F.col("l_partkey"), F.lit(7))).alias("rest"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms and largest components of vectors, by functions over arrays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), F.size(F.filter(v, lambda x: x > 0)).alias("positive"), F.array_position(v, F.array_max(v)).alias("largest"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    grouped = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return grouped.select("user_id", F.size("m").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON strings by path, by schema and as variants."""
    events = load(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("by_path"), F.from_json("props", "k int")["k"].alias("by_schema"), F.expr("variant_get(parse_json(props), '$.k', 'int')").alias("as_variant"))


def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's counts by kind put together with the count of all: maps concatenated, filtered and turned about."""
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    grouped = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("n"))
    both = grouped.withColumn("m", F.map_concat("m", F.create_map(F.lit("all"), "n")))
    return both.select("user_id", F.size("m").alias("keys"), F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, n: n * 4 >= F.col("n")))), ",").alias("common"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of plain text, partitioned by flag, read again and taken apart."""
    items = load(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", F.round("l_quantity").cast("long")).alias("value"), "l_returnflag")
    told = F.split("value", "\\|")
    return round_trip(items, "text", ("l_returnflag",)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(told[0].cast("long")).alias("orders"), F.sum(told[2].cast("long")).alias("quantity"))


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.round(squash("value"), 6).alias("squashed"))


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads by functions over groups: of each batch of rows first, then of parts of what the batches gave, then of the parts, so no function gets a whole group."""
    partial = load(spark, sf_dir, "events").select("event_type", "value").mapInArrow(extremes, "event_type string, low double, high double")
    parts = partial.groupBy("event_type", F.pmod(F.xxhash64("low", "high"), F.lit(64)).alias("part")).agg(lowest("low").alias("low"), highest("high").alias("high"))
    whole = parts.groupBy("event_type").agg(lowest("low").alias("low"), highest("high").alias("high"))
    return whole.select("event_type", F.round(F.col("high") - F.col("low"), 6).alias("spread"))


def window_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.round(spread("value").over(Window.partitionBy("user_id")), 6).alias("spread"))


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "events").select("event_id", "user_id", "value").groupBy("user_id").applyInPandas(above_least, "event_id long, user_id long, value double")
    return done.select("event_id", F.round("value", 4).alias("value"))


def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    left, right = (events.where(F.col("event_type") == k).select("user_id", "value") for k in ("click", "error"))
    return left.groupBy("user_id").cogroup(right.groupBy("user_id")).applyInPandas(matched, "user_id long, n_left long, n_right long")


def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "value").mapInArrow(positive, "event_id long, value double")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of event types by place, counted over all events."""
    kinds = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.lateralJoin(Letters(F.col("event_type").outer())).groupBy("place", "letter").agg(F.sum("n").alias("n"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations after a trip through CSV, JSON, ORC and partitioned Parquet."""
    nation = load(spark, sf_dir, "nation")
    out = None
    for kind, by, options in (("csv", (), {"header": "true"}), ("json", (), {}), ("orc", (), {}), ("parquet", ("n_regionkey",), {})):
        part = round_trip(nation, kind, by, **options).select(F.lit(kind).alias("format"), "n_nationkey", "n_name", "n_regionkey")
        out = part if out is None else out.unionByName(part)
    return out


def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders by a source of our own, which reads Parquet in stretches of rows and takes the filter along."""
    register(spark)
    orders = spark.read.format("stretches").option("path", f"{sf_dir}/orders.parquet").option("rows", 20_000).schema("o_orderkey long, o_orderstatus string, o_totalprice double").load()
    return orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


QUERIES = {
    "texts": texts, "dates": dates, "numbers": numbers, "arrays": arrays, "maps": maps, "merged_maps": merged_maps, "json": json, "scalar_udf": scalar_udf, "aggregate_udf": aggregate_udf, "window_udf": window_udf,
    "grouped_map": grouped_map, "cogrouped_map": cogrouped_map, "batch_map": batch_map, "table_function": table_function, "formats": formats, "text_files": text_files, "custom_source": custom_source,
}

SQL = {
    "texts": """SELECT p_partkey, upper(p_name) AS upper, substr(p_name, 2, 4) AS part, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, split_part(p_name, ' ', 1) AS first,
        levenshtein(p_name, p_type)::INT AS distance, lpad(p_size::VARCHAR, 4, '0') AS padded FROM part""",
    "dates": """SELECT o_orderkey, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
        date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS age, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "numbers": """SELECT l_orderkey, sum(l_quantity::BIGINT // 3)::BIGINT AS thirds, round(sum(sqrt(l_extendedprice)), 4) AS roots, sum(floor(log10(l_extendedprice)))::BIGINT AS digits,
        sum(l_partkey % 7)::BIGINT AS rest FROM lineitem GROUP BY ALL""",
    "arrays": """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(list_filter(embedding, lambda x: x > 0))::INT AS positive,
        list_position(embedding, list_max(embedding))::BIGINT AS largest FROM embeddings""",
    "maps": "SELECT user_id, count(DISTINCT event_type)::INT AS kinds, count(*) FILTER (event_type = 'click') AS clicks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys FROM events GROUP BY user_id",
    "merged_maps": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT user_id, 'all', count(*) FROM events GROUP BY user_id),
        a AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM c)
        SELECT user_id, count(*)::INT AS keys, string_agg(event_type, ',' ORDER BY event_type) FILTER (n * 4 >= most) AS common FROM a GROUP BY user_id""",
    "json": "SELECT event_id, (props->>'$.k')::INT AS by_path, (props->>'$.k')::INT AS by_schema, (props->>'$.k')::INT AS as_variant FROM events",
    "scalar_udf": "SELECT event_id, round(value / (1 + abs(value)), 6) AS squashed FROM events",
    "aggregate_udf": "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type",
    "window_udf": "SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS spread FROM events WINDOW w AS (PARTITION BY user_id)",
    "grouped_map": "SELECT event_id, round(value - min(value) OVER (PARTITION BY user_id), 4) AS value FROM events",
    "cogrouped_map": """SELECT user_id, count(*) FILTER (event_type = 'click') AS n_left, count(*) FILTER (event_type = 'error') AS n_right FROM events
        WHERE event_type IN ('click', 'error') GROUP BY user_id""",
    "batch_map": "SELECT event_id, value FROM events WHERE value > 0",
    "table_function": """WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT event_type, n, unnest(range(1, len(event_type) + 1)) AS place FROM k)
        SELECT place::INT AS place, substr(event_type, place, 1) AS letter, sum(n)::BIGINT AS n FROM l GROUP BY ALL""",
    "formats": "SELECT f AS format, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS f)",
    "text_files": "SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(round(l_quantity)::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY l_returnflag",
    "custom_source": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
}
