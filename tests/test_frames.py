"""Frames, running sums, overlaps and quantiles against plain versions."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators.frames import groups_frame, running_sum
from tidemill.operators.overlaps import overlap_join
from tidemill.operators.quantiles import exact_quantiles

BEGIN = dt.datetime(2024, 1, 1)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([None, 0, 1, 2, 3, 7]), st.sampled_from([None, 1.0, -2.5, 4.0])), max_size=14)


@QUICK
@given(rows=ROWS, before=st.integers(0, 2), after=st.integers(0, 2), exclude=st.sampled_from(["no others", "current row", "group", "ties"]))
def test_groups_frame_against_plain(spark, rows, before, after, exclude):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, k string, o int, v double")
    want = []
    for n, (key, order, _) in enumerate(rows):
        orders = sorted({o for k, o, _ in rows if k == key}, key=lambda o: (o is not None, o))
        at = orders.index(order)
        own = [(m, o, v) for m, (k, o, v) in enumerate(rows) if k == key and at - before <= orders.index(o) <= at + after]
        left = {"no others": own, "current row": [r for r in own if r[0] != n], "group": [r for r in own if r[1] != order], "ties": [r for r in own if r[1] != order or r[0] == n]}[exclude]
        values = [v for *_, v in left if v is not None]
        want.append((n, sum(values) if values else None, len(values)))
    got = groups_frame(df, "k", "o", "v", before, after, exclude)
    assert sorted((r["n"], r["frame_sum"], r["frame_count"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        groups_frame(df, "k", "o", "v", 1, 1, "rows")


@QUICK
@given(rows=ROWS, bucket=st.sampled_from([1, 2, 100]))
def test_running_sum_against_plain(spark, rows, bucket):
    timed = [(n, k, BEGIN + dt.timedelta(seconds=o) if o is not None else None, v) for n, (k, o, v) in enumerate(rows)]
    got = running_sum(spark.createDataFrame(timed, "n long, k string, ts timestamp_ntz, v double"), "k", "ts", "v", bucket)
    want = [(n, sum(v or 0 for k, o, v in rows if k == key and (o is None or (at is not None and o <= at)))) for n, (key, at, _) in enumerate(rows)]
    assert sorted((r["n"], r["running"]) for r in got.collect()) == want


@QUICK
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 300), st.sampled_from([-5, 0, 1, 2, 3, 64, 65, 1000, 40_000_000])), max_size=9), st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 300), st.sampled_from([1, 5, 128, 3_000_000, 10**9])), max_size=9))
def test_overlaps_against_all_pairs(spark, left, right):
    epoch = dt.datetime(1969, 12, 31, 23, 59, 59)

    def frame(rows):
        made = [(n, k, epoch + dt.timedelta(milliseconds=4 * b), epoch + dt.timedelta(milliseconds=4 * b, microseconds=size)) for n, (k, b, size) in enumerate(rows)]
        return spark.createDataFrame(made, "n long, k long, begin timestamp_ntz, stop timestamp_ntz"), made

    (a, x), (z, y) = frame(left), frame(right)
    want = sorted((p[0], q[0]) for p in x for q in y if p[1] == q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    got = overlap_join(a, z, "k", "begin", "stop")
    assert got.columns == ["n", "k", "begin", "stop", "r_n", "r_k", "r_begin", "r_stop"]
    assert sorted((r["n"], r["r_n"]) for r in got.collect()) == want


def test_a_long_interval_costs_two_rows(spark):
    """One interval of 30 years among seconds: it meets all and is copied to no more bins than a short one."""
    short = spark.range(200).select("id", F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 1_000_000).alias("begin"), F.timestamp_seconds(F.col("id") * 1_000_000 + 1).alias("stop"))
    long = spark.range(1).select("id", F.lit(1).alias("k"), F.timestamp_seconds(F.lit(0)).alias("begin"), F.timestamp_seconds(F.lit(946_080_000)).alias("stop"))
    assert overlap_join(long, short, "k", "begin", "stop").count() == overlap_join(short, long, "k", "begin", "stop").count() == 200


@pytest.mark.parametrize("accuracy", [10000, 40])
def test_quantiles_against_sorting(spark, accuracy):
    """Skewed, tied and few values, nulls, and a sketch so coarse that brackets are widened or hold much."""
    values = {"a": [float(k * k % 997) for k in range(5000)], "b": [1.0] * 700 + [2.0], "c": [5.0], "d": [], None: [3.0, -1.0]}
    rows = [(g, v) for g, own in values.items() for v in own] + [("d", None), ("a", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", [0.0, 0.123, 0.5, 0.999, 1.0], accuracy)
    for r in got.collect():
        own = sorted(values[r["g"]])
        assert r["n"] == len(own)
        for q, x in zip([0.0, 0.123, 0.5, 0.999, 1.0], r["q"], strict=True):
            at = q * (len(own) - 1)
            want = own[math.floor(at)] + (own[math.ceil(at)] - own[math.floor(at)]) * (at - math.floor(at)) if own else None
            assert x == want or abs(x - want) < 1e-9
    assert got.count() == 5
