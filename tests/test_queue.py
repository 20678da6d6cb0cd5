"""Durable rounds, analyses with a turn, and meters."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import external, queue
from weftline.sources.shared import durable
from weftline.streaming import meter

REQUESTS = "_key string, prompt string"


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def service(folder):
    """Fails by the prompt's name as often as it says: `fail-n`; each call is noted as a file."""

    def answer(prompt):
        import os
        import uuid

        open(f"{folder}/{prompt}~{uuid.uuid4().hex}", "w").close()
        n = sum(f.startswith(prompt + "~") for f in os.listdir(folder))
        if prompt.startswith("fail-") and n <= int(prompt.split("-")[1]):
            raise external.Retryable(f"try {n}")
        return prompt.upper()

    return answer


def calls(folder):
    return sorted(p.name.split("~")[0] for p in folder.iterdir())


def test_rounds_with_repeated_keys(spark, tmp_path):
    def failing(prompt):
        raise external.Retryable("busy")

    rows = [("a", "p"), ("a", "p"), ("b", "q")]
    got = external.call_with_rounds(spark.createDataFrame(rows, REQUESTS), failing, durable, (1.0, 2.0), lambda s: None, retries=0, base=0.001).collect()
    assert sorted((r._key, r.stage, len(r.error_history)) for r in got) == [("a", "max_retry", 3), ("a", "max_retry", 3), ("b", "max_retry", 3)]
    typed = spark.createDataFrame([(7, "p"), (7, "q")], "_key long, prompt string")
    assert sorted(map(tuple, external.call(typed, str.upper).select("_key", "reply").collect())) == [(7, "P"), (7, "Q")]


def test_queue_runs_what_is_due(spark, tmp_path):
    folder, clock = tmp_path / "calls", Clock()
    folder.mkdir()
    q = queue.RequestQueue(spark, str(tmp_path / "q"), (120.0, 300.0), clock=clock)
    q.add(spark.createDataFrame([("a", "one"), ("a", "fail-1"), ("a", "fail-2"), ("b", "fail-9"), (None, "one")], REQUESTS), "first")
    q.add(spark.createDataFrame([("x", "never")], REQUESTS), "first")
    options = {"retries": 0, "base": 0.001, "parallel": 1}
    assert q.run_due(service(str(folder)), **options) == 120.0
    assert q.run_due(service(str(folder)), **options) == 120.0, "nothing is due before its time"
    assert len(calls(folder)) == 5
    clock.now += 121
    assert q.run_due(service(str(folder)), **options) == 300.0
    assert {r.stage for r in q.results().where("_key = 'b'").collect()} == {"waiting"}
    clock.now += 301
    q.add(spark.createDataFrame([("late", "two")], REQUESTS))
    assert q.run_due(service(str(folder)), **options) is None
    got = sorted((str(r._key), str(r.reply), r.stage, [(h.attempt, h.error) for h in r.error_history], r.error) for r in q.results().collect())
    assert got == [
        ("None", "ONE", "done", [], None), ("a", "FAIL-1", "done", [(0, "try 1")], None), ("a", "FAIL-2", "done", [(0, "try 1"), (1, "try 2")], None), ("a", "ONE", "done", [], None),
        ("b", "None", "max_retry", [(0, "try 1"), (1, "try 2"), (2, "try 3")], "try 3"), ("late", "TWO", "done", [], None),
    ]


def test_a_lost_worker_loses_nothing(spark, tmp_path, monkeypatch):
    folder, clock = tmp_path / "calls", Clock()
    folder.mkdir()
    first = queue.RequestQueue(spark, str(tmp_path / "q"), (1.0,), lease=60.0, clock=clock)
    first.add(spark.createDataFrame([("a", "one"), ("b", "two")], REQUESTS))

    def killed(edit):
        raise KeyboardInterrupt

    options = {"retries": 0, "base": 0.001, "parallel": 1}
    # the worker is lost after its calls are written, before they are listed
    real = first.manifests.change
    monkeypatch.setattr(first.manifests, "change", lambda edit: real(edit) if "lease" not in first.manifests.load()[1] else killed(edit))
    with pytest.raises(KeyboardInterrupt):
        first.run_due(service(str(folder)), **options)
    second = queue.RequestQueue(spark, first.path, (1.0,), lease=60.0, clock=clock)
    assert 0 < second.run_due(service(str(folder)), **options) <= 60 and len(calls(folder)) == 2, "the lease still holds"
    clock.now += 61
    assert second.run_due(service(str(folder)), **options) is None
    assert sorted((r._key, r.reply) for r in second.results().collect()) == [("a", "ONE"), ("b", "TWO")]
    assert calls(folder) == ["one", "one", "two", "two"]


def test_analyses_take_turns(spark):
    rows = [("1", "data:image/png;base64,AAA", "coding", "p.exe", "W"), ("2", "BBB", "web", None, None), ("3", None, None, None, None), ("4", "data:,boom", "web", "", "")]
    screens = spark.createDataFrame(rows, "event_id string, screenshot string, mode string, active_process string, window_title string")

    def look(image, note):
        if image == "boom":
            raise RuntimeError("no answer")
        return f"KARAR: {'ŞÜPHELİ' if image == 'AAA' else 'TEMİZ'}\nGEREKÇE: {image}|{note}" if image else "?"

    got = {r.event_id: r for r in external.analysed(screens, look).collect()}
    assert (got["1"].suspicious, got["1"].verdict) == (True, "ŞÜPHELİ") and got["1"].reason.startswith("AAA|")
    assert "kodlama" in got["1"].raw and "p.exe" in got["1"].raw and (got["2"].suspicious, got["2"].verdict) == (False, "TEMİZ")
    assert [(got[i].suspicious, got[i].verdict) for i in "34"] == [(False, "HATA")] * 2 and got["4"].reason == "no answer"
    slow = external.analysed(screens.withColumn("screenshot", F.lit("x")), lambda i, n: time.sleep(0.3) or "KARAR: TEMİZ", at_once=1, turn=0.45).collect()
    assert sorted(r.reason == external.FULL for r in slow) == [False, False, True, True] and {r.verdict for r in slow if r.reason == external.FULL} == {"HATA"}


def test_rate_is_smoothed_and_tells_the_rest():
    r = meter.Rate(half=10.0)
    assert r.read(100)["seconds_left"] is None
    r.add(50, 5.0)
    assert r.read(100) == {"rows": 50, "per_second": 10.0, "per_minute": 600.0, "share": 0.5, "seconds_left": 5.0}
    for _ in range(20):
        r.add(20, 10.0)
    assert 1.9 < r.rate < 2.2 and r.read(450)["seconds_left"] == 0.0


def test_meter_while_a_stream_runs(spark, tmp_path):
    m = meter.Meter()
    spark.streams.addListener(m)
    query = spark.readStream.format("rate").option("rowsPerSecond", 200).load().writeStream.format("noop").queryName("metered").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and not (query.isActive and m.read("metered", 10**6)["rows"] > 100):
            time.sleep(0.2)
        got = m.read("metered", 10**6)
        assert query.isActive and got["rows"] > 100 and got["per_second"] > 0 and got["seconds_left"] > 0
    finally:
        query.stop()
        spark.streams.removeListener(m)


def test_batch_meter(spark):
    clock = Clock()
    m = meter.BatchMeter(spark, clock)
    frame = m.counted(spark.range(1000, numPartitions=4))
    assert frame.count() == 1000
    clock.now += 10
    assert m.read(4000) == {"rows": 1000, "per_second": 100.0, "per_minute": 6000.0, "share": 0.25, "seconds_left": 30.0}
