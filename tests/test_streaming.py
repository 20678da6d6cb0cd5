import datetime

import pytest

from weftline.streaming import live


@pytest.fixture
def feed(spark, tmp_path):
    """A function that makes a stream of the given rows, and one that runs a stream to its end."""

    def make(rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / name))

    def run(frame, name, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90), "the stream did not end"
        finally:
            query.stop()
        assert query.exception() is None and "batch" in live.progress(query)
        return spark.table(name).collect()

    return make, run


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_votes(feed):
    make, run = feed
    rows = [("e", "s", at(i), str(i), v) for i, v in enumerate([True, False, True, False, False])]
    got = run(live.votes(make(rows, "exam_id string, student_id string, ts timestamp, event_id string, suspicious boolean", "v")), "votes")
    assert [r.confirmed for r in sorted(got, key=lambda r: r.event_id)] == [False, False, True, False, False]


def test_throttle(feed):
    make, run = feed
    rows = [("a", at(i), f"{i:02}", False) for i in range(12)]
    got = run(live.throttled(make(rows, "addr string, ts timestamp, event_id string, flag boolean", "t")), "throttle")
    assert [r.blocked for r in sorted(got, key=lambda r: r.event_id)] == [False] * 10 + [True] * 2


def test_presence_and_gaps(feed):
    make, run = feed
    rows = [("s", at(0), "1", "active"), ("s", at(5), "2", "active"), ("s", at(9), "3", "left"), ("t", at(500), "4", "active")]
    stream = make(rows, "student_id string, ts timestamp, event_id string, state string", "p")
    got = [(r.student_id, r.status, r["at"].replace(tzinfo=None)) for r in sorted(run(live.presence(stream), "presence"), key=lambda r: r["at"])]
    # both have been silent for less than the limit, or have left
    assert got == [("s", "active", at(0)), ("s", "left", at(9)), ("t", "active", at(500))]
    assert [(r.student_id, r.n) for r in run(live.report_gaps(stream), "gaps")] == [("s", 3)]


def test_presence_turns_idle_by_event_time_and_state_ends(feed, spark):
    make, run = feed
    rows = [("s", at(0), "1", "active"), ("s", at(20), "2", "active"), ("u", at(30), "3", "left"), ("t", at(500), "4", "active")]
    stream = make(rows, "student_id string, ts timestamp, event_id string, state string", "i")
    found = run(live.presence(stream).repartition(1), "idle")
    assert sorted((r.student_id, r.status, r["at"].replace(tzinfo=None)) for r in found if r.student_id != "t") == [
        ("s", "active", at(0)), ("s", "idle", at(20)), ("u", "left", at(30)),
    ]


def test_timeouts(feed):
    make, run = feed
    events = make([("1", at(0)), ("2", at(1)), ("3", at(4000))], "event_id string, ts timestamp", "e")
    results = make([("1", at(5), True), ("2", at(30), True), ("3", at(4001), False)], "event_id string, done_at timestamp, suspicious boolean", "r")
    got = {r.event_id: r.suspicious for r in run(live.timed_out(events, results), "timeouts")}
    assert got["1"] is True and got.get("3") is False and got.get("2") is None


def test_received_lines(feed):
    make, run = feed
    lines = make([('{"event_id":"1","student_id":"s","ts":"2024-01-01T00:00:00Z","reason":"periodic","mode":"web"}',), ("{broken",), ('{"event_id":"2"}',)], "value string", "lines")
    events, bad = live.received(lines)
    got = run(live.routed(events), "received")
    assert [(r.event_id, r.route) for r in got] == [("1", "require_vlm")] and len(run(bad, "bad")) == 2
