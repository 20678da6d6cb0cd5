import functools
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftline.operators import sessions
from weftline.sources import jsonl, state


def test_jsonl(spark, tmp_path):
    good = [{"_key": f"{i}_FAST", "profile": "FAST", "messages": [{"role": "user", "content": "ğ"}]} for i in range(3)]
    first, second = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    first.write_text("\n\n".join(json.dumps(g, ensure_ascii=False) for g in good) + "\n")
    second.write_text('﻿{"_key":"9_MEM"}\nnot json\n{"x":1}\n')
    assert jsonl.read_strict(spark, str(first)).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(second)).collect()
    rows, bad = jsonl.read_lenient(spark, str(second))
    assert bad.count() >= 1 and jsonl.read_lenient(spark, str(tmp_path / "none"))[0].count() == 0
    assert {r._key for r in jsonl.read_keys(spark, str(first), str(second)).collect()} == {"0_FAST", "1_FAST", "2_FAST", "9_MEM"}
    ordered = jsonl.read_ordered(spark, [str(first), str(first)]).orderBy("src_idx", "line_no").collect()
    assert [(r.src_idx, r.line_no, r._key) for r in ordered][:4] == [(0, 1, "0_FAST"), (0, 3, "1_FAST"), (0, 5, "2_FAST"), (1, 1, "0_FAST")]
    assert {r.msg_hash for r in ordered} == {hashlib.sha1("user\nğ".encode()).hexdigest()}


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("\n".join(f"line {i} " + "x" * (i % 97) for i in range(1, 4001)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = jsonl.numbered_lines(spark, str(path))
        assert lines.select("value").rdd.getNumPartitions() > 1
        assert all(r.value.startswith(f"line {r.line_no} ") for r in lines.collect()) and lines.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_files_are_one_scan(spark, tmp_path):
    """Two thousand files: a plan of constant size, and the line numbers of each."""
    folder = tmp_path / "with space +%20é"
    folder.mkdir()
    paths = []
    for i in range(2000):
        paths.append(str(folder / f"f{i % 7} {i:04}.jsonl"))
        (folder / f"f{i % 7} {i:04}.jsonl").write_text("\n".join(["", *(json.dumps({"_key": f"{i}_{k}"}) for k in range(i % 3 + 1))]) + "\n")
    paths.reverse()
    few, many = (jsonl.read_ordered(spark, p, "_key string") for p in (paths[:3], paths))
    size = lambda f: len(f._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(few) == size(many)
    got = many.collect()
    assert len(got) == sum(i % 3 + 1 for i in range(2000))
    for r in got:
        i, k = map(int, r._key.split("_"))
        assert (r.src_path, r.src_idx, r.line_no) == (paths[1999 - i], 1999 - i, k + 2)
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_ordered(spark, [str(folder / "none")]).collect()


def test_arrays_and_sinks(spark, tmp_path):
    (tmp_path / "bank.json").write_text(json.dumps([{"Question": f"q{i}", "Difficulty": "Level 1"} for i in range(5)]))
    bank = jsonl.read_array(spark, str(tmp_path / "bank.json"), "Question string, Difficulty string", 1, 3)
    assert [(r.qi, r.Question) for r in bank.orderBy("qi").collect()] == [(1, "q1"), (2, "q2"), (3, "q3")]
    (tmp_path / "pretty.json").write_text(json.dumps([{"Question": f"q{i}"} for i in range(3)], indent=2))
    assert [(r.qi, r.Question) for r in jsonl.read_array(spark, str(tmp_path / "pretty.json"), "Question string").collect()] == [(0, "q0"), (1, "q1"), (2, "q2")]
    jsonl.write_both(bank, str(tmp_path / "both"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "both/array").glob("part*")]
    assert sorted(r["qi"] for part in parts for r in part) == [1, 2, 3]
    jsonl.write_both(bank.repartition(2, "qi"), str(tmp_path / "two"))
    assert sum(len(json.loads(p.read_text())) for p in (tmp_path / "two/array").glob("part*")) == 3
    verdicts = bank.withColumn("verdict", F.when(F.col("qi") == 1, "pass").otherwise("fail"))
    jsonl.write_by(verdicts, str(tmp_path / "by"))
    assert (tmp_path / "by/by_verdict/by_verdict=pass").exists() and spark.read.json(str(tmp_path / "by/all")).count() == 3
    sink = jsonl.append_batches(str(tmp_path / "log"))
    sink(bank, 0)
    sink(bank, 0)
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    splits = jsonl.read_splits(spark, "Question string", train=str(tmp_path / "both/lines"))
    assert splits["train"].count() == 3


def test_state(spark, tmp_path):
    store = state.EvidenceStore(spark, str(tmp_path / "s"))
    assert store.snapshot().first().payload == "{}" and store.evidence().count() == 0
    store.save_snapshot('{"a":1}', 1)
    store.save_snapshot('{"a":2}', 2)
    assert store.snapshot().first().payload == '{"a":2}'
    store.save_snapshot("[broken", 3)
    assert store.snapshot().first().payload == "{}"
    meta = lambda e, s: json.dumps({"examId": e, "student": {"id": s}, "reason": "tab switch"})
    rows = [("1", "2024-01-01 00:00:00", meta("A", "s/1"), b"\xff\xd8\xff", "image/jpeg", 1), ("1", "2024-01-02 00:00:00", meta("A", "s/1"), b"x", "image/jpeg", 2), ("2", "2024-01-03 00:00:00", meta("B", "s2"), None, None, 3)]
    frame = spark.createDataFrame(rows, "event_id string, c string, metadata string, image binary, mime_type string, ingest_seq long").withColumn("created_at", F.to_timestamp("c"))
    store.save_evidence(frame)
    assert [r.event_id for r in store.history().collect()] == ["2", "1"] and [r.event_id for r in store.history(5, "A").collect()] == ["1"]
    assert bytes(store.one("1").first().image) == b"x" and "image" not in store.history().columns
    assert [r.has_image for r in sessions.history_items(store.history()).collect()] == [False, True]
    state.export(store.evidence(), str(tmp_path / "x"), "A")
    about = json.loads("".join(p.read_text() for p in (tmp_path / "x/manifest").glob("part*")))
    assert (about["examId"], about["eventCount"], about["examCode"]) == ("A", 1, "")
    assert about["events"] == [{"eventId": "1", "examId": "A", "student": {"id": "s/1"}, "reason": "tab switch"}]
    assert spark.read.json(str(tmp_path / "x/events")).first()["name"] == "s_1_tab_switch_1" and (tmp_path / "x/events/student=s_1").exists()
    assert spark.read.parquet(str(tmp_path / "x/images")).first()["name"] == "s_1_tab_switch_1.jpg"
    assert state.jdbc_options("postgresql://u:p@h/db", "t")["url"] == "jdbc:postgresql://h:5432/db"
    with pytest.raises(ValueError):
        state.jdbc_options("mysql://h/db", "t")


def test_database_tables(spark, tmp_path):
    """The statements are those of PostgreSQL, which another database that knows ON CONFLICT runs too."""
    connect = functools.partial(sqlite3.connect, str(tmp_path / "d.sqlite"))
    with connect() as c:
        c.execute("CREATE TABLE evidence (event_id TEXT PRIMARY KEY, metadata TEXT, image BLOB)")
    rows = spark.createDataFrame([("1", "old", b"x", 1), ("1", "new", b"y", 2), ("2", "only", None, 1)], "event_id string, metadata string, image binary, ingest_seq long")
    for _ in range(2):
        state.upsert(rows.coalesce(1), connect, "evidence", "event_id", "ingest_seq", mark="?")
    with connect() as c:
        assert sorted(c.execute("SELECT * FROM evidence").fetchall()) == [("1", "new", b"y"), ("2", "only", None)]
    kept = state.SnapshotTable(connect, mark="?")
    kept.create()
    assert kept.load("exam") == "{}"
    kept.save("exam", '{"a":1}')
    kept.save("exam", '{"a":2}')
    assert kept.load("exam") == '{"a":2}'
    assert state.upsert_sql("t", "k", ["k", "v"]) == "INSERT INTO t (k, v) VALUES (%s, %s) ON CONFLICT (k) DO UPDATE SET v = excluded.v"
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert state.with_retries(flaky, 3, 0.5, waits.append) == "up" and waits == [0.5, 0.5]
    with pytest.raises(ZeroDivisionError):
        state.with_retries(lambda: 1 // 0, 2, 0, waits.append)
