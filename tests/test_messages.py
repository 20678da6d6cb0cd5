"""A growing log of typed messages: nothing is lost or doubled when the query stops, fails or starts again."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import lines
from weftline.streaming import messages


def line(**fields):
    return json.dumps({"ts": "2024-01-01T00:00:00Z", **fields})


def append(folder, name, *texts, end="\n"):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "a", newline="") as f:
        f.write("\n".join(texts) + end)


def run(frame, folder, sink):
    query = frame.writeStream.foreachBatch(sink).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    finally:
        query.stop()
    return query


def read(spark, path, name):
    return sorted((r.file, r.position) for r in spark.read.parquet(f"{path}/{name}").select("file", "position").collect())


def test_restart_takes_each_line_once(spark, tmp_path):
    folder, out = tmp_path / "log", str(tmp_path / "out")
    append(folder, "a.jsonl", *[line(type="heartbeat", token=f"t{i}") for i in range(50)])
    append(folder, "b.jsonl", line(type="join", token="x"), "", "{broken")
    append(folder, "a.jsonl", '{"type":"heartbeat","ts":"2024-01-01T00:00:00Z","tok', end="")
    stream = lambda: messages.log(spark, str(folder), partitionBytes="700")
    run(stream(), tmp_path / "c", messages.sort_out(out))
    assert len(read(spark, out, "heartbeat")) == 50
    # the line that was being written is completed, files grow, a new one comes, and the batch fails on its first try
    append(folder, "a.jsonl", 'en":"late"}', line(type="heartbeat", token="t51"))
    append(folder, "c.jsonl", line(type="leave", token="y"))
    tries = []

    def failing(batch, number):
        messages.sort_out(out)(batch, number)
        tries.append(number)
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        run(stream(), tmp_path / "c", failing)
    run(stream(), tmp_path / "c", messages.sort_out(out))
    run(stream(), tmp_path / "c", messages.sort_out(out))
    assert tries
    beats = spark.read.parquet(f"{out}/heartbeat")
    assert sorted(r.token for r in beats.collect()) == sorted([*(f"t{i}" for i in range(50)), "late", "t51"])
    assert beats.select("file", "position").distinct().count() == 52
    assert len(read(spark, out, "join")) == len(read(spark, out, "leave")) == 1
    assert [(r.value, r.reason) for r in spark.read.parquet(f"{out}/bad").collect()] == [("{broken", "not_an_object")]


def test_batches_are_bounded_while_the_query_runs(spark, tmp_path):
    folder, seen = tmp_path / "log", []
    append(folder, "a.jsonl", "x" * 20)
    stream = messages.log(spark, str(folder), batchBytes="100")
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append([r.value for r in b.orderBy("file", "position").collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        append(folder, "a.jsonl", *[f"{i:09}" for i in range(30)], "y" * 500, "z")
        query.processAllAvailable()
    finally:
        query.stop()
    assert [v for part in seen for v in part] == ["x" * 20, *[f"{i:09}" for i in range(30)], "y" * 500, "z"]
    assert all(sum(len(v) + 1 for v in part) <= 100 for part in seen if "y" * 500 not in part) and len(seen) >= 5


@pytest.mark.parametrize("size", [1, 3, 7, 50, 10_000])
def test_ranges_of_a_file_hold_each_line_once(tmp_path, size):
    texts = ["", "a", "bb", "é" * 10, "", "x" * 100_000, "\udcff".encode("utf-8", "surrogateescape").decode("latin-1"), "last\r"]
    (tmp_path / "f").write_bytes("\n".join(texts).encode() + b"\nnot complete")
    whole = lines.line_end(str(tmp_path), "f", 0, (tmp_path / "f").stat().st_size)
    found = []
    edges = [e for e in lines.cut(0, whole, max(size, whole // 2000))]
    for a, b in edges:
        for batch in lines.lines(str(tmp_path), lines.Range("f", a, b), whole):
            found += zip(batch.column("position").to_pylist(), batch.column("value").to_pylist(), strict=True)
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t.encode()) + 1
    assert found == list(zip(starts, [t.removesuffix("\r") for t in texts], strict=True))


def test_batch_read_and_a_shortened_file(spark, tmp_path):
    folder = tmp_path / "log"
    append(folder, "a.jsonl", "1", "2", "3")
    append(folder, "b.txt", "no")
    spark.dataSource.register(lines.LineFiles)
    got = spark.read.format("weftline_lines").options(path=str(folder), suffix=".jsonl", partitionBytes="2").load()
    assert [(r.file, r.position, r.value) for r in got.orderBy("position").collect()] == [("a.jsonl", 0, "1"), ("a.jsonl", 2, "2"), ("a.jsonl", 4, "3")]
    keep = lambda batch, number: None
    run(messages.log(spark, str(folder)), tmp_path / "c", keep)
    (folder / "a.jsonl").write_text("1\n")
    with pytest.raises(Exception, match="shorter"):
        append(folder, "b.txt", "more")
        run(messages.log(spark, str(folder)), tmp_path / "c", keep)


GOOD = {
    "join": {"token": "t"}, "leave": {"token": "t"}, "heartbeat": {"token": "t"}, "session": {"token": "t"},
    "verify": {"name": "N", "student_id": "s", "code": "C"}, "pairing_create": {"token": "t", "code": "c"}, "pairing_exchange": {"code": "c"},
    "screenshot": {"token": "t", "screenshot": "data:", "client_context": {"active_process": "p", "extensions": ["e"]}},
    "alert": {"token": "t", "extensions": ["a", "b"], "details": "d"}, "focus": {"token": "t", "focused": False},
    "start_exam": {"exam_id": "e", "minutes": 1.5, "allowed_urls": ["u"]}, "stop_exam": {}, "update_duration": {"minutes": 3},
    "change_mode": {"mode": "web"}, "update_urls": {"allowed_urls": []}, "update_exam_code": {"exam_code": ""},
}


def test_every_type_has_its_schema(spark):
    assert set(GOOD) == set(messages.TYPES)
    rows = [("f", i, line(type=name, **fields)) for i, (name, fields) in enumerate(GOOD.items())]
    wrong = [
        ("[1]", "not_an_object"), ("nonsense", "not_an_object"), ("7", "not_an_object"), (line(type="dance"), "unknown_type"), (line(token="t"), "unknown_type"),
        (line(type="join"), "missing_token"), (json.dumps({"type": "leave", "token": "t"}), "missing_ts"), (line(type="focus", token="t", focused="maybe"), "type_mismatch"),
        (line(type="start_exam", exam_id="e", allowed_urls="u"), "type_mismatch"), (line(type="verify", name="N" * 101, student_id="s"), "bad_length"),
        (line(type="verify", name=" ", student_id="s"), "bad_length"), (line(type="pairing_exchange", code="c" * 129), "bad_length"), (line(type=3), "unknown_type"),
    ]
    rows += [("f", 100 + i, text) for i, (text, _) in enumerate(wrong)] + [("f", 999, "  "), ("f", 998, None)]
    frame = spark.createDataFrame(rows, "file string, position long, value string")
    for i, (name, fields) in enumerate(GOOD.items()):
        got = messages.of_type(frame, name)
        r = got.first()
        assert got.count() == 1 and r.position == i
        for key, value in fields.items():
            assert (r[key].asDict() | {"window_title": None} == value | {"window_title": None}) if isinstance(value, dict) else r[key] == value
    assert {(r.position - 100): r.reason for r in messages.bad(frame).collect()} == {i: reason for i, (_, reason) in enumerate(wrong)}
    assert messages.bad(frame.where(F.lit(False))).count() == 0
