"""Windows, deduplication, joins and state over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.sources.tables import load, scratch

#: Keys of state that the users of stream_timers are dealt to.
BUCKETS = 1024


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; spark's own settings stay as they are."""
    other = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of files; ts becomes a zoned timestamp, as watermarks need."""
    kind = load(spark, sf_dir, name).schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(rows: DataFrame, mode: str = "append", spark: SparkSession | None = None) -> DataFrame:
    """Run a stream over what there is and read what it wrote, with spark or the stream's own session. In complete mode the last batch's rows stay."""
    spark = spark or rows.sparkSession
    path = scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").select(rows.columns)


def _times(df: DataFrame) -> DataFrame:
    return df.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("begin"), F.col("window.end").cast("timestamp_ntz").alias("end"), "n", "total")


def _totals() -> list:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by day."""
    return _times(drain(stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(*_totals()), "complete"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in two days, every day."""
    return _times(drain(stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(*_totals()), "complete"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by six hours of rest."""
    grouped = stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "6 hours").alias("window"), "user_id").agg(F.count("*").alias("n"))
    return drain(grouped, "complete").select("user_id", F.col("window.start").cast("timestamp_ntz").alias("begin"), F.col("window.end").cast("timestamp_ntz").alias("end"), "n")


def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users did each kind of thing: duplicates are dropped within the watermark."""
    once = stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drain(once.select("user_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("users"))


def with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events joined with a fixed table: spending by market segment of the customer of the user's number."""
    fixed = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = stream(spark, sf_dir).where("event_type = 'purchase'").join(fixed, "user_id").select("c_mktsegment", "value")
    return drain(joined).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams: purchases at most a day after a click of the same user, counted by user."""
    clicks = stream(spark, sf_dir).where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts")).withWatermark("click_ts", "2 days")
    buys = stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "2 days")
    near = clicks.join(buys, F.expr("user_id = buyer AND buy_ts >= click_ts AND buy_ts <= click_ts + INTERVAL 1 DAY"))
    return drain(near.select("user_id", "click_ts", "buy_ts")).groupBy("user_id").agg(F.count("*").alias("pairs"))


class Running(StatefulProcessor):
    """Count and largest value of each user so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, most double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, most = self.seen.get() if self.seen.exists() else (0, float("-inf"))
        for part in rows:
            n, most = n + len(part), max(most, float(part["value"].max()))
        self.seen.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    def close(self) -> None:
        pass


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's count and largest value, kept in state from batch to batch."""
    rows = stream(stateful(spark), sf_dir).select("user_id", "value").groupBy("user_id").transformWithStateInPandas(Running(), "user_id long, n long, most double", "Update", "None")
    return drain(rows, "update", spark).groupBy("user_id").agg(F.max("n").alias("n"), F.max("most").alias("most"))


class Visits(StatefulProcessor):
    """Visits of a bucket's users: each row puts off its visit's end to six hours after the latest; a timer at the first end due gives out the visits that have ended, and they are forgotten.

    One value and one timer serve all users of a bucket, so calls to the state store don't grow with the number of users.
    Rows of one batch are taken by time, so that a pause within it ends a visit too.
    """

    def __init__(self, pause_ms: int) -> None:
        self.pause = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "user array<bigint>, begin array<bigint>, last array<bigint>, n array<bigint>, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else ([], [], [], [], None)
        if held[4] is not None:
            self.handle.deleteTimer(held[4])
        fresh = [part[["user_id", "at"]].to_numpy(np.int64) for part in rows]
        who, at = np.concatenate(fresh).T
        user, begin, last, n = (np.append(np.array(a, np.int64), b) for a, b in zip(held[:4], (who, at, at, np.ones_like(at)), strict=True))
        order = np.lexsort([begin, np.arange(len(user)) >= len(held[0]), user])  # a user's open visit, then rows by time
        user, begin, last, n = user[order], begin[order], last[order], n[order]
        first = np.append(True, user[1:] != user[:-1])
        latest = np.maximum(last, last[np.flatnonzero(first)[np.cumsum(first) - 1]])
        edge = np.flatnonzero(first | np.append(True, last[1:] - latest[:-1] >= self.pause))
        user, begin, last, n = user[edge], np.minimum.reduceat(begin, edge), np.maximum.reduceat(last, edge), np.add.reduceat(n, edge)
        yield from self._give(key, (user, begin, last, n), np.append(user[1:] == user[:-1], False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        visits = [np.array(x, np.int64) for x in self.open.get()[:4]]
        yield from self._give(key, visits, visits[2] + self.pause <= timerValues.getCurrentWatermarkInMs())

    def _give(self, key, visits, ended: np.ndarray) -> Iterator[pd.DataFrame]:
        """Give out the visits that have ended and keep the others, with a timer at the first end due."""
        if ended.all():
            self.open.clear()
        else:
            due = int(visits[2][~ended].min()) + self.pause
            self.open.update((*(x[~ended].tolist() for x in visits), due))
            self.handle.registerTimer(due)
        if ended.any():
            yield pd.DataFrame({"bucket": key[0]} | {c: x[ended] for c, x in zip(("user_id", "begin", "last", "n"), visits, strict=True)})

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the three days in which they arrive: their own, but for each seventh, which comes three times as long after where there are such days."""
    own = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 3)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", own.alias("own"))
    last = events.agg(F.max("own")).first()[0] or 0
    late = (F.col("event_id") % 7 == 0) & (F.col("own") + 3 <= last)
    return events.select("event_id", "user_id", "ts", (F.col("own") + F.when(late, 3).otherwise(0)).alias("arrival"))


def timed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits, ended by six hours without an event, from a file for each three days of arrival; state expires by timers on event time.

    The watermark is a day behind the latest event. An event counts unless it is older than the watermark that was in force before the batch
    in which it arrives (set by the batches up to the one before last); a user's last visit isn't given where the last watermark lies before its end.
    """
    path, dealt, rows = scratch(spark), scratch(spark), arrivals(spark, sf_dir)
    rows.write.partitionBy("arrival").parquet(dealt)
    rows = spark.read.schema(rows.schema).parquet(dealt)
    for k in sorted(r[0] for r in rows.select("arrival").distinct().collect()):  # files in order of arrival, each from its own part
        rows.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.parquet(f"{path}/arrived={k:06}")
    other = stateful(spark)
    read = other.readStream.schema("event_id long, user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    bucket = F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).cast("long")
    read = read.select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day").withColumn("at", F.unix_millis("ts"))
    visits = read.groupBy("bucket").transformWithStateInPandas(Visits(6 * 3600 * 1000), "bucket long, user_id long, begin long, last long, n long", "Append", "EventTime")
    user = F.when(F.col("bucket") >= 0, F.col("user_id")).alias("user_id")
    return drain(visits, spark=spark).select(user, F.timestamp_millis("begin").cast("timestamp_ntz").alias("begin"), F.timestamp_millis("last").cast("timestamp_ntz").alias("last"), "n")


_DAYS = "date_trunc('day', ts)"

QUERIES = {
    "stream_tumbling": tumbling,
    "stream_sliding": sliding,
    "stream_sessions": sessions,
    "stream_dedup": first_of_kind,
    "stream_static_join": with_customers,
    "stream_stream_join": clicks_to_purchases,
    "stream_state": running,
    "stream_timers": timed_visits,
}

SQL = {
    "stream_tumbling": f"SELECT event_type, {_DAYS} AS begin, {_DAYS} + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": f"""SELECT event_type, begin, begin + INTERVAL 2 DAY AS "end", count(*) AS n, round(sum(value), 4) AS total
        FROM (SELECT event_type, value, unnest([{_DAYS}, {_DAYS} - INTERVAL 1 DAY]) AS begin FROM events) GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "stream_static_join": "SELECT c_mktsegment, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' GROUP BY c_mktsegment",
    "stream_stream_join": """SELECT c.user_id, count(*) AS pairs FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 DAY
        WHERE c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY c.user_id""",
    "stream_state": "SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id",
    "stream_timers": """WITH o AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) // 3 AS own FROM events),
        a AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, ts AS exact, own + CASE WHEN event_id % 7 = 0 AND own + 3 <= max(own) OVER () THEN 3 ELSE 0 END AS arrival FROM o),
        b AS (SELECT arrival, row_number() OVER (ORDER BY arrival) AS k, max(exact) AS latest FROM a GROUP BY arrival),
        m AS (SELECT k, arrival, max(latest) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM b),
        r AS (SELECT a.user_id, a.ts FROM a JOIN m USING (arrival) WHERE seen IS NULL OR a.exact > date_trunc('millisecond', seen) - INTERVAL 1 DAY),
        g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS begin, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k QUALIFY lead(k) OVER (PARTITION BY user_id ORDER BY k) IS NOT NULL OR last + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(latest)) FROM b) - INTERVAL 1 DAY""",
}
