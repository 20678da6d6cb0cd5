"""Evidence as a log-structured table: appended batches, key buckets, compaction beside running readers.

A batch is written as two sets of files, narrow rows and images, each divided by a bucket of the event's id and sorted by
it; a manifest then lists the batch. An event's last version counts, which is found among the narrow rows of its bucket; images are
looked up once the rows are chosen, by id and version, and never moved to find them. Compaction writes the last versions
anew and swaps them for the batches it has read, while readers go on reading the manifest that they began with; batches that
have come meanwhile stay. `vacuum` removes what the last manifests do not name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import sessions
from weftline.sources.manifest import Manifests

NARROW = "event_id string, created_at timestamp, metadata string, mime_type string, ingest_seq long"
IMAGES = "event_id string, ingest_seq long, image binary"
BUCKETS = 64


class EvidenceTable:
    """`buckets` is chosen when the table is first written, and kept."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets
        self.manifests = Manifests(spark, path)

    def _buckets(self, content: dict) -> int:
        return content.get("buckets", self._wanted)

    def _bucket(self, event_id: Column, content: dict) -> Column:
        return F.pmod(F.xxhash64(event_id), F.lit(self._buckets(content))).cast("int")

    def _write(self, rows: DataFrame, part: str, name: str, content: dict, schema: str) -> None:
        columns = [c.split()[0] for c in schema.split(", ")]
        dealt = rows.select(*columns, self._bucket(F.col("event_id"), content).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "event_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{part}/batch={name}")

    def append(self, rows: DataFrame, name: str | None = None) -> int:
        """Adds rows (event_id, created_at, metadata, image, mime_type, ingest_seq); the manifest's number. A batch of a name that is there already changes nothing."""
        _, content = self.manifests.load()
        name = name or uuid.uuid4().hex
        if name in content.get("done", []) or name in content.get("batches", []):
            return self.manifests.load()[0]
        buckets = self._buckets(content)
        self._write(rows, "narrow", name, content, NARROW)
        self._write(rows.where("image IS NOT NULL"), "images", name, content, IMAGES)

        def edit(now: dict) -> dict | None:
            if now.get("buckets", buckets) != buckets:
                raise RuntimeError("the table has got other buckets meanwhile")
            if name in now.get("done", []) or name in now.get("batches", []):
                return None
            return now | {"buckets": buckets, "batches": [*now.get("batches", []), name]}

        return self.manifests.change(edit)

    def sink(self, label: str):
        """A function for `writeStream.foreachBatch`; a batch that runs again is written once. `label` names the query."""
        return lambda batch, number: self.append(batch, f"{label}-{number:012}")

    def _read(self, part: str, schema: str, content: dict) -> DataFrame:
        wide = f"{schema}, bucket int"
        if not content.get("batches"):
            return self.spark.createDataFrame([], wide)
        return self._files(part, wide, content["batches"])

    def _files(self, part: str, schema: str, batches: list[str]) -> DataFrame:
        places = [f"{self.path}/{part}/batch={name}" for name in batches]
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{part}").parquet(*places).drop("batch")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("event_id", "bucket")]
        return rows.groupBy("bucket", "event_id").agg(F.max_by(F.struct(*rest), "ingest_seq").alias("e")).select("bucket", "event_id", "e.*")

    def rows(self, version: int | None = None) -> DataFrame:
        """The last version of every event, without images, of a manifest, by default the last."""
        _, content = self.manifests.load(version)
        return self._latest(self._read("narrow", NARROW, content)).drop("bucket")

    def one(self, event_id: str, version: int | None = None) -> DataFrame:
        """The last version of one event; only its bucket is read."""
        _, content = self.manifests.load(version)
        own = (F.col("bucket") == self._bucket(F.lit(event_id), content)) & (F.col("event_id") == event_id)
        return self._latest(self._read("narrow", NARROW, content).where(own)).drop("bucket")

    def image(self, event_id: str, version: int | None = None) -> DataFrame:
        """event_id, mime_type, image of the event's last version, if it has an image; only its bucket is read."""
        _, content = self.manifests.load(version)
        own = (F.col("bucket") == self._bucket(F.lit(event_id), content)) & (F.col("event_id") == event_id)
        last = self._latest(self._read("narrow", NARROW, content).where(own))
        images = self._read("images", IMAGES, content).where(own)
        return images.join(F.broadcast(last.select("ingest_seq", "mime_type")), "ingest_seq").where("startswith(mime_type, 'image/')").select("event_id", "mime_type", "image")

    def history(self, limit: int = sessions.HISTORY_DEFAULT, exam_id: str | None = None, version: int | None = None) -> DataFrame:
        """The newest events, without images. The limit is kept between 1 and HISTORY_MOST."""
        rows = self.rows(version).withColumn("image", F.lit(None).cast("binary"))
        return sessions.listed(rows, limit, exam_id)

    def with_images(self, chosen: DataFrame, version: int | None = None) -> DataFrame:
        """The chosen rows, no more than HISTORY_MOST, with their images: rows are broadcast to the images, which stay where they are."""
        _, content = self.manifests.load(version)
        few = chosen.limit(sessions.HISTORY_MOST).withColumn("bucket", self._bucket(F.col("event_id"), content))
        images = self._read("images", IMAGES, content).join(F.broadcast(few.select("bucket", "event_id", "ingest_seq")), ["bucket", "event_id", "ingest_seq"])
        return few.drop("bucket").join(images.select("event_id", "image"), "event_id", "left")

    def compact(self) -> int:
        """Replaces the batches of the last manifest by one of their last versions; the manifest's number. Batches that come meanwhile stay."""
        number, content = self.manifests.load()
        old = content.get("batches", [])
        if len(old) < 2:
            return number
        name = f"compact-{uuid.uuid4().hex}"
        last = self._latest(self._read("narrow", NARROW, content))
        self._write(last, "narrow", name, content, NARROW)
        kept = self._files("narrow", f"{NARROW}, bucket int", [name]).select("bucket", "event_id", "ingest_seq")
        self._write(self._read("images", IMAGES, content).join(kept, ["bucket", "event_id", "ingest_seq"], "left_semi"), "images", name, content, IMAGES)

        def edit(now: dict) -> dict | None:
            batches = now.get("batches", [])
            if not set(old) <= set(batches):  # another compaction was first
                return None
            # names of what was put together are kept, so that a stream's batch that runs again is known
            return now | {"batches": [name, *(b for b in batches if b not in old)], "done": [*now.get("done", []), *(b for b in old if not b.startswith("compact-"))]}

        return self.manifests.change(edit)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` manifests, and folders that none of these names. Run it when no batch is being written."""
        numbers = self.manifests.numbers()
        named = {b for n in numbers[-keep:] for b in self.manifests.load(n)[1].get("batches", [])}
        gone = [f for f in self.manifests.folders("narrow", "images") if f.split("/batch=")[1] not in named]
        self.manifests.remove([*gone, *(f"manifest/{n:020}.json" for n in numbers[:-keep])])
        return gone
