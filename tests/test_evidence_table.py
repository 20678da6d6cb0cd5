"""The evidence table: one bucket for a lookup, the last version, and readers that compaction does not disturb."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources.evidence import EvidenceTable
from weftline.sources.manifest import Manifests

ROWS = "event_id string, created_at timestamp, metadata string, image binary, mime_type string, ingest_seq long"


def row(i, seq, exam="e", image=None, mime="application/octet-stream"):
    return (str(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seq), f'{{"examId":"{exam}","seq":{seq}}}', image, mime, seq)


@pytest.fixture
def table(spark, tmp_path):
    t = EvidenceTable(spark, str(tmp_path / "evidence"), 8)
    t.append(spark.createDataFrame([row(i, i, image=b"\xff\xd8old%d" % i, mime="image/jpeg") for i in range(40)], ROWS))
    t.append(spark.createDataFrame([row(i, 100 + i, "f", image=b"\xff\xd8new%d" % i if i % 2 else None, mime="image/jpeg" if i % 2 else "text/plain") for i in range(10)], ROWS))
    return t


def state(table, version=None):
    return {(r.event_id, r.ingest_seq) for r in table.rows(version).collect()}


WANT = {(str(i), 100 + i if i < 10 else i) for i in range(40)}


def read_files(frame):
    return {f.split("/bucket=")[1].split("/")[0] for f in frame.inputFiles()}


def test_last_version_and_images(table, spark):
    assert state(table) == WANT
    assert [r.ingest_seq for r in table.one("3").collect()] == [103] and table.one("none").count() == 0
    assert bytes(table.image("3").first().image) == b"\xff\xd8new3" and bytes(table.image("30").first().image) == b"\xff\xd8old30"
    assert table.image("4").count() == 0, "the last version has no image"
    newest = table.history(3)
    assert [r.event_id for r in newest.collect()] == ["9", "8", "7"]
    assert {r.event_id: r.image and bytes(r.image) for r in table.with_images(newest).collect()} == {"9": b"\xff\xd8new9", "8": None, "7": b"\xff\xd8new7"}
    assert {r.event_id for r in table.history(100, "e").collect()} == {str(i) for i in range(10, 40)}
    assert EvidenceTable(spark, table.path + "-none").rows().count() == 0


def test_a_lookup_reads_one_bucket(table):
    plan = table.one("3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", " ")
    scan = table.one("3")._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in scan
    assert len({r[0] for r in table._read("narrow", "event_id string", table.manifests.load()[1]).where(F.col("event_id") == "3").select("bucket").distinct().collect()}) == 1
    assert "image" not in table.history(5)._jdf.queryExecution().optimizedPlan().toString().replace("images/", "").replace("image#", "").split("Relation")[-1]


def test_reading_during_compaction(table, spark):
    before, _ = table.manifests.load()
    reader = table.rows()
    after = table.compact()
    assert after == before + 1 and len(table.manifests.load()[1]["batches"]) == 1
    # the reader that began before still sees its state, and so does whoever asks for that version
    assert {(r.event_id, r.ingest_seq) for r in reader.collect()} == state(table, before) == state(table) == WANT
    table.append(spark.createDataFrame([row(3, 500)], ROWS))
    assert [r.ingest_seq for r in table.one("3").collect()] == [500] and state(table, after) == WANT
    assert table.vacuum(1) and state(table) == (WANT - {("3", 103)}) | {("3", 500)}
    assert bytes(table.image("30").first().image) == b"\xff\xd8old30"


def test_batches_that_come_during_compaction_stay(table, spark, monkeypatch):
    late = spark.createDataFrame([row(99, 900)], ROWS)
    write = table._write

    def slow(rows, part, name, content, schema):
        write(rows, part, name, content, schema)
        if name.startswith("compact-") and part == "images":
            EvidenceTable(spark, table.path).append(late)
            EvidenceTable(spark, table.path).compact()

    monkeypatch.setattr(table, "_write", slow)
    table.compact()
    assert state(table) == WANT | {("99", 900)}


def test_a_batch_that_runs_again_counts_once(table, spark):
    sink = table.sink("query")
    frame = spark.createDataFrame([row(7, 700)], ROWS)
    sink(frame, 0)
    number = table.manifests.load()[0]
    sink(frame, 0)
    assert table.manifests.load()[0] == number
    table.compact()
    sink(frame, 0)
    assert len(table.manifests.load()[1]["batches"]) == 1 and [r.ingest_seq for r in table.one("7").collect()] == [700]


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    manifests = Manifests(spark, str(tmp_path / "m"))

    def add(i):
        own = Manifests(spark, manifests.path)
        for k in range(5):
            own.change(lambda now, k=k: now | {"names": [*now.get("names", []), f"{i}-{k}"]})

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, content = manifests.load()
    assert sorted(content["names"]) == sorted(f"{i}-{k}" for i in range(4) for k in range(5)) and number == 19
    assert manifests.numbers() == list(range(20))
