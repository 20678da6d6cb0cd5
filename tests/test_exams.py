"""Live exams against the batch rules, in any order of arrival, over restarts, until their state is empty."""

import datetime
import random

import pytest

from weftline.operators import sessions
from weftline.streaming import exams

EVENTS = "room string, ts timestamp, event_id string, action string, exam_id string, minutes double, student_id string, code string"


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture
def log(spark, tmp_path):
    """Appends a file of rows to a folder, and runs an operator over the folder's stream: each call restarts it from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", exams.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    files = []

    def append(rows, schema, name="in"):
        files.append(0)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"part={len(files)}"))

    def run(build, schema, name="in", mode="append"):
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        got = []
        query = build(stream).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120), "the stream did not end"
        finally:
            query.stop()
        assert query.exception() is None
        return got

    yield append, run, tmp_path
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def held(spark, folder, name, *variables):
    """Rows that the state of a stream still holds."""
    return sum(spark.read.format("statestore").option("path", str(folder / f"c-{name}")).option("stateVarName", v).load().count() for v in variables)


def command(s, action, exam=None, minutes=None, room="r", student=None, code=None, event=None):
    return (room, at(s), event or f"{s:06}{action}", action, exam, minutes, student, code)


def test_exam_ends_by_stop_next_start_or_its_minutes(log, spark):
    append, run, folder = log
    # out of order within the lateness
    append([command(5, "stop"), command(0, "start", "a", 60.0), command(7, "start", "b", 1.0), command(500, "start", "far", 1.0, room="clock")], EVENTS)
    got = run(exams.rooms, EVENTS)
    seen = [(r.kind, r.exam_id, r.reason, (r["at"].replace(tzinfo=None) - at(0)).total_seconds()) for r in got if r.room == "r"]
    # b's minute is over without any event of its room: the watermark of another one's rings
    assert seen == [("started", "a", None, 0), ("ended", "a", "manual", 5), ("started", "b", None, 7), ("ended", "b", "duration_expired", 67)]
    append([command(600, "start", "c", 600.0), command(610, "duration", minutes=0.5), command(611, "start", "d", 1.0), command(612, "start", "e", 0.0), command(2000, "stop", room="clock")], EVENTS)
    got = run(exams.rooms, EVENTS)
    seen = [(r.kind, r.exam_id, r.reason, (r["at"].replace(tzinfo=None) - at(0)).total_seconds()) for r in got if r.room == "r"]
    assert seen == [
        ("started", "c", None, 600), ("ended", "c", "next_start", 611), ("started", "d", None, 611), ("ended", "d", "next_start", 612),
        ("started", "e", None, 612), ("ended", "e", "duration_expired", 612),
    ]
    assert [(r.exam_id, r.reason) for r in got if r.room == "clock" and r.kind == "ended"] == [("far", "duration_expired")]
    append([command(9000, "stop", room="clock")], EVENTS)
    run(exams.rooms, EVENTS)
    assert held(spark, folder, "in", "exam", "codes") == 0 and held(spark, folder, "in", "waiting") <= 1


def test_exams_in_any_order_equal_the_batch(log, spark):
    append, run, _ = log
    rng = random.Random(4)
    rows = [command(rng.randrange(0, 900) * 2 + (i % 2), rng.choice(["start", "start", "stop"]), f"e{i:03}", rng.choice([0.5, 1.0, 5.0]), event=f"{i:04}") for i in range(60)]
    rows = list({r[1]: r for r in rows}.values())
    rng.shuffle(rows)
    append(rows, EVENTS)
    append([command(100_000, "stop", room="clock")], EVENTS)
    got = [r for r in run(lambda s: exams.rooms(s, "1 hour"), EVENTS) if r.room == "r"]
    ended = {r.exam_id: r["at"] for r in got if r.kind == "ended"}
    live = {(r.exam_id, r["at"], ended[r.exam_id]) for r in got if r.kind == "started"}
    commands = spark.createDataFrame(rows, EVENTS).selectExpr("ts", "action", "exam_id", "minutes")
    assert live == {(r.exam_id, r.started_at, r.ended_at) for r in sessions.exam_intervals(commands).collect()}


def test_codes_are_used_once_within_their_life_and_exam(log, spark):
    append, run, folder = log
    rows = [command(0, "pair", student="early", code="x"), command(1, "start", "a", 60.0), command(2, "pair", student="s", code="1"), command(3, "pair", student="s", code="2"), command(4, "pair", student="t", code="3")]
    rows += [command(10, "exchange", code="1"), command(11, "exchange", code="1"), command(12, "exchange", code="none"), command(20, "exchange", "other", code="3")]
    rows += [command(123, "exchange", code="2"), command(150, "pair", student="u", code="4"), command(151, "stop"), command(152, "exchange", code="4")]
    append(rows[:6], EVENTS)
    first = run(exams.rooms, EVENTS)
    append([*rows[6:], command(5000, "stop", room="clock")], EVENTS)
    got = {r.event_id: (r.kind, r.student_id, r.reason) for r in first + run(exams.rooms, EVENTS) if r.event_id}
    assert got["000000pair"] == ("refused", "early", "no_exam") and got["000002pair"][0] == "code_made"
    assert got["000010exchange"] == ("accepted", "s", None)
    assert got["000011exchange"][::2] == ("refused", "unknown_or_expired") == got["000012exchange"][::2]
    assert got["000020exchange"] == ("refused", "t", "other_exam")
    assert got["000123exchange"][::2] == ("refused", "unknown_or_expired"), "a code dies 120 seconds after it was made"
    assert got["000152exchange"][::2] == ("refused", "unknown_or_expired"), "a code dies with its exam"
    append([command(9000, "stop", room="clock")], EVENTS)
    run(exams.rooms, EVENTS)
    assert held(spark, folder, "in", "exam", "codes") == 0


def test_focus_episodes(log, spark):
    append, run, folder = log
    schema = "student_id string, ts timestamp, event_id string, focused boolean"
    rows = [("s", at(0), "1", False), ("s", at(2), "2", True), ("s", at(10), "3", False), ("s", at(11), "4", False), ("t", at(0), "5", False)]
    append([*rows, ("clock", at(40), "9", True)], schema)
    got = run(exams.unfocus_episodes, schema)
    short = lambda rows: sorted((r.student_id, r.kind, (r.since.replace(tzinfo=None) - at(0)).total_seconds(), (r["at"].replace(tzinfo=None) - at(0)).total_seconds()) for r in rows)
    assert short(got) == [("s", "open", 10, 13), ("t", "open", 0, 3)]
    append([("s", at(41), "6", True), ("clock", at(9000), "10", True)], schema)
    assert short(run(exams.unfocus_episodes, schema)) == [("s", "closed", 10, 41), ("t", "lapsed", 0, 7200)]
    assert held(spark, folder, "in", "away") == 0


COUNTED = "event_id string, exam_id string, student_id string, reason string, ts timestamp, status string, suspicious boolean, route string, kind string, current_exam string"


def counted(s, event, exam="e", student="s", status="clean", suspicious=None, route=None, kind=None, current="e"):
    return (event, exam, student, "periodic", at(s), status, suspicious, route, kind, current)


def test_repeated_events_count_once_across_batches(log, spark):
    append, run, folder = log
    append([counted(0, "1", status="suspicious"), counted(1, "2"), counted(1, "2"), counted(2, None), counted(2, None), counted(2, None, student="t"), counted(3, "1", exam="f")], COUNTED)
    first = {r.exam_id: (r.total, r.alerts) for r in run(exams.counters, COUNTED, mode="update")}
    assert first == {"e": (4, 1), "f": (1, 0)}
    append([counted(60, "1", status="suspicious"), counted(61, "3", suspicious=True)], COUNTED)
    assert {r.exam_id: (r.total, r.alerts) for r in run(exams.counters, COUNTED, mode="update")} == {"e": (5, 2)}
    append([counted(400_000, "later", exam="g")], COUNTED)
    append([counted(900_000, "last", exam="h")], COUNTED)
    run(exams.counters, COUNTED, mode="update")
    rest = spark.read.format("statestore").option("path", str(folder / "c-in"))
    assert rest.option("operatorId", 0).load().count() <= 2 and rest.option("operatorId", 1).load().count() <= 2


def test_live_alert_counts_equal_the_batch(log, spark):
    append, run, _ = log
    rng = random.Random(6)
    rows = [counted(i, str(i), rng.choice("ef"), rng.choice("st"), rng.choice(["suspicious", "clean"]), route=rng.choice(["direct_alert", None]), kind=rng.choice(["client_alert", None, None])) for i in range(40)]
    append([*rows, *rows[:10]], COUNTED)
    append(rows[5:15], COUNTED)
    got = {}
    for r in run(exams.alert_counts, COUNTED, mode="update"):
        got[r.exam_id, r.student_id] = max(r.alerts, got.get((r.exam_id, r.student_id), 0))
    assert got == {(r.exam_id, r.student_id): r.alerts for r in sessions.alert_counts(spark.createDataFrame(rows, COUNTED)).collect()}
