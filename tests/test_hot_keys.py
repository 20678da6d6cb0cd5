"""Ranges, hot keys and hot instants: equal to step by step, and no task gets more than its share."""

import datetime
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from weftline.operators import hotkeys, ranges, sessions


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.mark.parametrize("cells", [1, 2, 5, 40])
def test_last_mark_before_each_event(spark, cells):
    rng = random.Random(cells)
    times = [rng.choice([rng.randrange(600), 300, 300, 301, rng.random() * 3]) for _ in range(800)] + [None, -5, 10_000]
    marks = [(at(t), f"x{i:03}") for i, t in enumerate([*(rng.randrange(600) for _ in range(40)), 300, 300, 301, 0.5])] + [(None, "null")]
    events = spark.createDataFrame([(i, at(t) if t is not None else None) for i, t in enumerate(times)], "event_id long, ts timestamp")
    got = sessions.as_of(events, spark.createDataFrame(marks, "ts timestamp, exam_id string"), "exam_id", cells)
    order = sorted(m for m in marks if m[0] is not None)
    found = {r.event_id: r.mark and r.mark.exam_id for r in got.collect()}
    assert len(found) == len(times)
    for i, t in enumerate(times):
        place = bisect_right(order, (at(t), "~")) if t is not None else 0
        assert found[i] == (order[place - 1][1] if place else None), (i, t)
    assert sessions.as_of(events.limit(0), spark.createDataFrame(marks, "ts timestamp, exam_id string"), "exam_id", cells).count() == 0
    assert {r.mark for r in sessions.as_of(events, spark.createDataFrame([], "ts timestamp, exam_id string"), "exam_id", cells).collect()} == {None}


def test_a_million_events_in_ten_minutes_are_spread(spark):
    """Half of them at one instant: the largest cell holds about one part in eight."""
    events = spark.range(1_000_000, numPartitions=4).select(F.col("id").alias("event_id"), F.timestamp_micros(F.when(F.col("id") % 2 == 0, F.lit(300_000_000)).otherwise(F.pmod(F.xxhash64("id"), F.lit(600_000_000)))).alias("ts"))
    cuts = ranges.edges(events, F.unix_micros("ts"), 8)
    marks = spark.createDataFrame([(at(-86400 * 365 * 54 - 1e5), "never")], "ts timestamp, exam_id string").limit(0)
    marks = marks.unionByName(spark.range(20).select(F.timestamp_micros(F.col("id") * 30_000_000).alias("ts"), F.col("id").cast("string").alias("exam_id")))
    got = sessions.as_of(events, marks, "exam_id", 8)
    assert got.where(F.col("mark.exam_id").cast("long") != F.floor(F.unix_micros("ts") / 30_000_000)).count() == 0 and got.count() == 1_000_000
    us = F.unix_micros("ts")
    largest = events.groupBy(ranges.cell(us, cuts), ranges.dealt(us, cuts, F.col("event_id"))).count().agg(F.max("count")).first()[0]
    assert largest < 1_000_000 / 8 * 1.6


def test_exam_intervals_over_ranges(spark):
    rng = random.Random(3)
    rows = [(at(rng.choice([rng.randrange(5000), 77])), rng.choice(["start", "stop"]), f"x{i:04}", rng.randrange(1, 40)) for i in range(500)]
    got = sessions.exam_intervals(spark.createDataFrame(rows, "ts timestamp, action string, exam_id string, minutes int")).collect()
    order, want = sorted(rows, key=lambda r: (r[0], r[2])), set()
    for i, (ts, action, exam, minutes) in enumerate(order):
        if action == "start":
            over = ts + datetime.timedelta(minutes=minutes)
            want.add((exam, ts, min(over, order[i + 1][0]) if i + 1 < len(order) else over))
    assert {(r.exam_id, r.started_at, r.ended_at) for r in got} == want and len(got) == len(want)


def cooled(times, seconds=7):
    last, out = None, []
    for t in times:
        go = last is None or t >= last + seconds
        last = t if go else last
        out.append(go)
    return out


def blocked(rows):
    held, out = [], []
    for t, right in rows:
        held = [x for x in held if x >= t - 60_000_000]
        stop = len(held) >= 10
        out.append(stop)
        if not stop:
            held = [] if right else [*held, t]
    return out


EVENTS = "student_id string, ts timestamp, event_id string, addr string, flag boolean"


@pytest.mark.parametrize("rate", [0.2, 1.0, 30.0])
def test_cooldown_of_a_hot_key(spark, rate):
    rng = random.Random(int(rate * 10))
    rows = [(rng.choice(["hot", "hot", "hot", "warm", None]), round(rng.random() * 3000 / rate, 3), f"{i:05}") for i in range(3000)]
    frame = spark.createDataFrame([(k, at(t), e, "a", False) for k, t, e in rows], EVENTS)
    want = {}
    for key in {k for k, *_ in rows}:
        own = sorted((t, e) for k, t, e in rows if k == key)
        want |= dict(zip([e for _, e in own], cooled([round(t * 1e6) for t, _ in own], 7_000_000), strict=True))
    for chunk in (50, 400, 10**6):
        got = sessions.cooled_down(frame, chunk=chunk)
        assert got.columns == [*(c for c in frame.columns if c != "flag"), "emitted"]
        assert {r.event_id: r.emitted for r in got.collect()} == want


@pytest.mark.parametrize("right", [0.0, 0.02, 0.5])
def test_throttle_of_a_hot_address(spark, right):
    rng = random.Random(int(right * 100))
    rows = [(rng.choice(["hot", "hot", "b", None]), round(rng.random() * 900, 3), f"{i:05}", rng.random() < right) for i in range(2000)]
    frame = spark.createDataFrame([("s", at(t), e, k, f) for k, t, e, f in rows], EVENTS)
    want = {}
    for key in {k for k, *_ in rows}:
        own = sorted((t, e, f) for k, t, e, f in rows if k == key)
        want |= dict(zip([e for _, e, _ in own], blocked([(round(t * 1e6), f) for t, _, f in own]), strict=True))
    for chunk in (150, 10**6):
        assert {r.event_id: r.blocked for r in sessions.throttled(frame, chunk=chunk).collect()} == want


def test_a_million_events_of_one_key_are_spread(spark):
    events = spark.range(1_000_000, numPartitions=4).select(F.lit("one").alias("student_id"), F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(6_000_000_000))).alias("ts"), F.lpad(F.col("id").cast("string"), 7, "0").alias("event_id"))
    times = sorted(r[0] for r in events.select(F.unix_micros("ts")).collect())
    got = sessions.cooled_down(events, chunk=125_000)
    assert got.where("emitted").count() == sum(cooled(times, 7_000_000))
    wide = events.select(*hotkeys._lead("student_id")[:2], "event_id")
    cut = hotkeys._cut(wide, spark.createDataFrame([("one", 1_000_000)], "_k string, _n long"), 125_000)
    assert cut.groupBy("_w_chunk").count().agg(F.max("count")).first()[0] < 1.3 * 125_000


def test_chunks_of_several_hot_addresses_are_joined(spark):
    """Five addresses share the chunks' cuts; without right codes each round moves an address on by one chunk, so chunks should be few."""
    rows = [(f"k{i % 5}" if i % 5 else None, i * 1000, f"{i:05}", i % 97 == 0) for i in range(5000)]
    cut = spark.createDataFrame([(*r, r[1] // 20_000) for r in rows], "_w_key string, _w_time long, event_id string, _w_flag boolean, _w_chunk int")
    got = hotkeys._joined(cut, 200).groupBy("_w_key", "_w_chunk").agg(F.count("*").alias("n"), F.min("_w_time").alias("lo"), F.max("_w_time").alias("hi")).collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= 200 and len(got) == 25
    for key in {r._w_key for r in got}:
        own = sorted((r._w_chunk, r.lo, r.hi) for r in got if r._w_key == key)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:], strict=False))
