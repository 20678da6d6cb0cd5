"""Snapshots and evidence of monitored sessions, in files or over JDBC."""

from __future__ import annotations

import time
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weftline.operators import sessions

EVIDENCE = "event_id string, created_at timestamp, metadata string, image binary, mime_type string, ingest_seq long"
SNAPSHOT = "version long, payload string"


class EvidenceStore:
    """Evidence rows and state snapshots under one folder of Parquet files.

    Writes only append; readers take the last version, so that a write that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def save_snapshot(self, payload: str, version: int) -> None:
        self.spark.createDataFrame([(version, payload)], SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{self.path}/snapshot")

    def snapshot(self) -> DataFrame:
        """One row: the last payload; {} if there is none, or if it is no JSON object."""
        last = self._read("snapshot", SNAPSHOT).agg(F.max_by("payload", "version").alias("payload"))
        sound = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
        return last.select(F.when(sound, F.col("payload")).otherwise("{}").alias("payload"))

    def save_evidence(self, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in EVIDENCE.split(", "))).write.mode("append").parquet(f"{self.path}/evidence")

    def evidence(self) -> DataFrame:
        return sessions.latest_evidence(self._read("evidence", EVIDENCE))

    def history(self, limit: int = sessions.HISTORY_DEFAULT, exam_id: str | None = None) -> DataFrame:
        return sessions.listed(self.evidence(), limit, exam_id)

    def one(self, event_id: str) -> DataFrame:
        return self.evidence().where(F.col("event_id") == event_id)

    def sink(self):
        """A function for `writeStream.foreachBatch`."""
        return lambda batch, number: self.save_evidence(batch)


def jdbc_options(url: str, table: str) -> dict[str, str]:
    """Reader and writer options for a PostgreSQL URL; other schemes are refused."""
    parts = urlsplit(url)
    if parts.scheme not in ("postgres", "postgresql"):
        raise ValueError(f"unsupported database URL scheme: {parts.scheme or 'none'}")
    options = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}", "dbtable": table, "driver": "org.postgresql.Driver"}
    return options | {k: v for k, v in (("user", parts.username), ("password", parts.password)) if v}


def with_retries(action, attempts: int = 3, delay: float = 1.0, wait=time.sleep):
    """The action's result; it is tried so many times, with a fixed delay between."""
    for left in range(attempts - 1, -1, -1):
        try:
            return action()
        except Exception:
            if not left:
                raise
            wait(delay)


def upsert_sql(table: str, key: str, columns: list[str], mark: str = "%s") -> str:
    """INSERT ... ON CONFLICT DO UPDATE of all columns: the last write of a key wins."""
    others = ", ".join(f"{c} = excluded.{c}" for c in columns if c != key)
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({key}) DO UPDATE SET {others}"


def upsert(rows: DataFrame, connect, table: str, key: str, order: str, mark: str = "%s", batch: int = 1000, attempts: int = 3, delay: float = 1.0) -> None:
    """Writes the last row (by `order`) of each key into a database table, by each partition in batches and transactions of its own.

    `connect` opens a connection of Python's database interface inside the tasks; `mark` is its placeholder.
    A batch that fails is tried again with a new connection; since the last write wins, repeating one changes nothing.
    """
    columns = [c for c in rows.columns if c != order]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key)), order).alias("r")).select(key, "r.*").select(*columns)
    statement = upsert_sql(table, key, columns, mark)

    def write(partition):
        held = []

        def put():
            connection = connect()
            try:
                connection.cursor().executemany(statement, held)
                connection.commit()
            finally:
                connection.close()

        for row in partition:
            held.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))
            if len(held) >= batch:
                with_retries(put, attempts, delay)
                held = []
        if held:
            with_retries(put, attempts, delay)

    last.foreachPartition(write)


class SnapshotTable:
    """Named JSON snapshots in a database table (key, payload, updated_at), the last write winning. `connect` as for `upsert`."""

    def __init__(self, connect, table: str = "snapshots", mark: str = "%s", attempts: int = 3, delay: float = 1.0):
        self.connect, self.table, self.mark, self.attempts, self.delay = connect, table, mark, attempts, delay

    def _run(self, statement: str, values: tuple) -> list:
        def once():
            connection = self.connect()
            try:
                cursor = connection.cursor()
                cursor.execute(statement, values)
                found = cursor.fetchall() if cursor.description else []
                connection.commit()
                return found
            finally:
                connection.close()

        return with_retries(once, self.attempts, self.delay)

    def create(self) -> None:
        self._run(f"CREATE TABLE IF NOT EXISTS {self.table} (key TEXT PRIMARY KEY, payload TEXT NOT NULL, updated_at TIMESTAMP NOT NULL)", ())

    def save(self, key: str, payload: str) -> None:
        statement = (
            f"INSERT INTO {self.table} (key, payload, updated_at) VALUES ({self.mark}, {self.mark}, CURRENT_TIMESTAMP) "
            "ON CONFLICT (key) DO UPDATE SET payload = excluded.payload, updated_at = excluded.updated_at"
        )
        self._run(statement, (key, payload))

    def load(self, key: str) -> str:
        found = self._run(f"SELECT payload FROM {self.table} WHERE key = {self.mark}", (key,))
        return found[0][0] if found else "{}"


def export(evidence: DataFrame, path: str, exam_id: str) -> None:
    """An exam's archive: manifest/ (one JSON line: examId, examCode, examStartedAt, exportedAt, eventCount, events), and events/ and
    images/ with a folder for each student, rows named as files are to be. The archive holds the newest HISTORY_MOST events.
    """
    about, events = sessions.manifest(evidence, exam_id)
    # bounded: no more than HISTORY_MOST events
    listed = events.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("o"), F.col("event_id").alias("i"), "event"))).alias("e"))
    whole = about.crossJoin(listed).select("*", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["event"]), ","), F.lit("]")).alias("events")).drop("e")
    line = F.to_json(F.struct("examId", "examCode", "examStartedAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("exportedAt"), "eventCount"))
    text = F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"events":'), "events", F.lit("}"))
    whole.withColumn("line", line).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    reason = F.coalesce(F.get_json_object("metadata", "$.reason"), F.get_json_object("metadata", "$.type"))
    named = sessions.listed(evidence, sessions.HISTORY_MOST, exam_id).select("event_id", "metadata").join(events.select("event_id", "student_id"), "event_id")
    named = named.select(
        sessions.T.safe_name(F.col("student_id"), "unknown").alias("student"), sessions.download_name(F.col("student_id"), reason, F.col("event_id")).alias("name"), "event_id", "metadata"
    )
    named.write.mode("overwrite").partitionBy("student").json(f"{path}/events")
    images = evidence.select("event_id", "image", "mime_type").where("image IS NOT NULL AND startswith(mime_type, 'image/')")
    suffix = F.when(F.col("mime_type") == "image/png", ".png").otherwise(".jpg")
    images.join(named.drop("metadata"), "event_id").withColumn("name", F.concat("name", suffix)).write.mode("overwrite").partitionBy("student").parquet(f"{path}/images")
