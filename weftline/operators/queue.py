"""Requests to an outside service as a durable queue: rounds with due times, a lease, and outcomes that survive whoever calls.

Requests get ids of their own when they are added, so that repeated keys stay apart. A round takes what is due, calls, writes the
outcomes and then lists them in the queue's manifest in one step, with the time from which what failed is due again. Whoever works on
the queue holds its lease meanwhile; if he is lost, the lease runs out, the round was never listed, and the next one repeats
it: calls may repeat, but no request and no outcome is lost. Nobody sleeps between rounds: `run_due` says when
to come again, to whatever calls it (a scheduler, or a streaming query with a processing-time trigger).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import external
from weftline.sources.manifest import Manifests

_OUTCOMES = "id string, round int, reply string, error string, due double"
WAITS = (120.0, 300.0)


class RequestQueue:
    """Under `path`: requests/, outcomes/ and manifest/. `waits`: seconds before each further round of what failed; `clock`: the time in seconds."""

    def __init__(self, spark: SparkSession, path: str, waits: tuple[float, ...] = WAITS, lease: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.waits, self.lease, self.clock = spark, path.rstrip("/"), waits, lease, clock
        self.manifests = Manifests(spark, path)
        self.owner = uuid.uuid4().hex

    def add(self, requests: DataFrame, name: str | None = None) -> None:
        """Adds requests (_key, prompt). Those of a name that is there already are not added again."""
        name = name or uuid.uuid4().hex
        if name in self.manifests.load()[1].get("requests", []):
            return
        ids = F.concat(F.lit(f"{name}-"), F.monotonically_increasing_id().cast("string"))
        requests.select(ids.alias("id"), F.col("_key").cast("string").alias("_key"), "prompt").write.mode("overwrite").parquet(f"{self.path}/requests/{name}")
        self.manifests.change(lambda now: None if name in now.get("requests", []) else now | {"requests": [*now.get("requests", []), name]})

    def _read(self, part: str, schema: str, content: dict) -> DataFrame:
        places = [f"{self.path}/{part}/{n}" for n in content.get(part, [])]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _state(self, content: dict) -> DataFrame:
        """id, _key, prompt and what its rounds have come to: rounds, done, due, history."""
        outcomes = self._read("outcomes", _OUTCOMES, content)
        failed = F.struct(F.col("round").alias("attempt"), "error")
        last = outcomes.groupBy("id").agg(
            F.count(F.lit(1)).cast("int").alias("rounds"), F.bool_or(F.col("error").isNull()).alias("done"), F.max("due").alias("due"),
            F.max(F.when(F.col("error").isNull(), F.col("reply"))).alias("reply"),
            # no more entries than there are rounds
            F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), failed))).alias("error_history"),
        )
        return self._read("requests", "id string, _key string, prompt string", content).join(last, "id", "left")

    def _open(self, content: dict) -> DataFrame:
        state = self._state(content).withColumn("rounds", F.coalesce("rounds", F.lit(0)))
        return state.where(~F.coalesce("done", F.lit(False)) & (F.col("rounds") <= len(self.waits)))

    def _leased(self) -> dict | None:
        """The content of the manifest with the lease taken, or None if somebody else holds it."""
        taken: dict = {}

        def edit(now: dict) -> dict | None:
            held = now.get("lease")
            taken["refused"] = bool(held and held["owner"] != self.owner and held["until"] > self.clock())
            return None if taken["refused"] else now | {"lease": {"owner": self.owner, "until": self.clock() + self.lease}}

        number = self.manifests.change(edit)
        return None if taken["refused"] else self.manifests.load(number)[1]

    def run_due(self, service: Callable[[str], str], **options) -> float | None:
        """Calls for all requests that are due, once; seconds until the next are due (0: now, or when the lease of another ends), or None if none is left.

        Options as for external.call: with `parallel` and `per_minute`, one rate holds for all executors.
        """
        content = self._leased()
        if content is None:
            return max(0.0, self.manifests.load()[1].get("lease", {}).get("until", 0.0) - self.clock())
        now = self.clock()
        due = self._open(content).where(F.coalesce("due", F.lit(0.0)) <= now).select("id", "prompt", F.col("rounds").alias("round"))
        name = uuid.uuid4().hex
        called = external.call(due, service, key="id", **options)
        wait = F.get(F.array(*map(F.lit, (*map(float, self.waits), 0.0))), F.col("round"))
        kept = called.join(due.select("id", "round"), "id").select("id", "round", "reply", "error", F.when(F.col("error").isNotNull(), F.lit(now) + wait).alias("due"))
        kept.write.parquet(f"{self.path}/outcomes/{name}")

        def edit(held: dict) -> dict | None:
            if held.get("lease", {}).get("owner") != self.owner:
                return None  # the lease ran out and another one works: this round does not count
            return {k: v for k, v in held.items() if k != "lease"} | {"outcomes": [*held.get("outcomes", []), name]}

        content = self.manifests.load(self.manifests.change(edit))[1]
        following = self._open(content).agg(F.min(F.coalesce("due", F.lit(0.0)))).first()[0]
        return None if following is None else max(0.0, following - self.clock())

    def results(self) -> DataFrame:
        """_key, reply, error, stage (done, waiting, max_retry), error_history of every request."""
        state = self._state(self.manifests.load()[1]).withColumn("rounds", F.coalesce("rounds", F.lit(0)))
        stage = F.when(F.coalesce("done", F.lit(False)), "done").when(F.col("rounds") > len(self.waits), "max_retry").otherwise("waiting")
        history = F.coalesce("error_history", F.array().cast("array<struct<attempt:int,error:string>>"))
        last = F.when(stage != "done", F.try_element_at(history, F.lit(-1))["error"])
        return state.select("_key", F.when(stage == "done", F.col("reply")).alias("reply"), last.alias("error"), stage.alias("stage"), history.alias("error_history"))
