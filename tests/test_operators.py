from __future__ import annotations

import datetime as dt

import pytest
from compare import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_join, interval_join, salted_join, top_per_group
from tidemill.plans.registry import QUERIES
from tidemill.sources.ranges import register
from tidemill.sources.tables import round_trip

BEGIN = dt.datetime(2024, 1, 1)
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 40)), max_size=12)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame([(k, key, at(s)) for k, (key, s) in enumerate(rows)], "n long, `key` long, ts timestamp_ntz")


@QUICK
@given(left=ROWS, right=ROWS, bucket=st.sampled_from([None, 1, 10, 1000]))
def test_asof_join_against_plain(spark, left, right, bucket):
    got = asof_join(frame(spark, left), frame(spark, right), "key", "ts", "ts", {"ts": "before"}, bucket)
    want = []
    for k, (key, s) in enumerate(left):
        earlier = [r for own, r in right if own == key and r <= s]
        want.append((k, key, at(s), at(max(earlier)) if earlier else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@QUICK
@given(left=ROWS, right=ROWS)
def test_interval_join_against_plain(spark, left, right):
    got = interval_join(frame(spark, left), frame(spark, right), "key", "ts", "ts", 7).select("n", "r_n").collect()
    want = [(a, b) for a, (k, s) in enumerate(left) for b, (j, t) in enumerate(right) if k is not None and k == j and 0 <= t - s <= 7]
    assert sorted(map(tuple, got)) == sorted(want)


def test_salted_join_gives_the_plain_join(spark):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    assert sorted(map(tuple, salted_join(left, right, "k", 4).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_salted_join_sends_no_copies_through_the_driver(spark):
    left, right = spark.range(100).select("id", (F.col("id") % 7).alias("k")), spark.range(7).select(F.col("id").alias("k"))
    plan = salted_join(left, right, "k", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_top_per_group_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 9, 3), (2, None, 1)], "g int, v int, n int")
    assert sorted(map(tuple, top_per_group(df, "g", [F.desc_nulls_last("v"), F.col("n")], 2).collect()), key=repr) == [(1, 5, 1), (1, 9, 3), (2, None, 1)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_formats_keep_rows(spark, kind):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None), (3, 'say "é"', -1.0)], "n int, t string, x double")
    assert sorted(map(tuple, round_trip(df, kind).collect())) == sorted(map(tuple, df.collect()))


def test_custom_source_reads_every_part(spark, tmp_path):
    register(spark)
    spark.range(101).select("id", (F.col("id") % 4).cast("string").alias("kind")).repartition(3).write.option("parquet.block.size", "64").parquet(str(tmp_path / "in"))
    read = spark.read.format("stretches").option("path", str(tmp_path / "in")).option("rows", 7).schema("kind string, id long").load()
    assert sorted(r["id"] for r in read.collect()) == [*range(101)] and read.rdd.getNumPartitions() >= 15
    some = read.where("kind = '3' AND id > 50")
    assert sorted(r["id"] for r in some.collect()) == [k for k in range(51, 101) if k % 4 == 3]
    spark.range(0).select("id", F.lit("x").alias("kind")).write.parquet(str(tmp_path / "none"))
    assert not spark.read.format("stretches").option("path", str(tmp_path / "none")).schema("kind string, id long").load().collect()


def test_late_rows_are_left_out_and_others_counted(spark, tmp_path):
    """Rows behind the watermark that the batch before last had set don't count in append mode."""
    schema = "ts timestamp, v int"
    for n, rows in enumerate([[(at(0), 1), (at(7200), 1)], [(at(7300), 1)], [(at(60), 1), (at(10800), 1)], [(at(30000), 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    out = []
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counted = rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.sum("v").alias("n"))
    query = counted.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    query.awaitTermination()
    assert {(r["window"]["start"], r["n"]) for r in out} == {(at(0), 1), (at(7200), 2), (at(10800), 1)}


def test_hints_choose_the_joins(spark):
    plan = QUERIES["join_hints"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert all(plan.count(x) == 1 for x in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin"))
