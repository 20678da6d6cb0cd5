"""How fast work goes and how long it will take: streams by their progress, batches by an accumulator."""

from __future__ import annotations

import time
from collections.abc import Callable
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Rate:
    """Rows a second, smoothed: what lies `half` seconds back counts half."""

    def __init__(self, half: float = 60.0):
        self.half, self.rows, self.rate, self._seconds = half, 0, None, 0.0

    def add(self, rows: int, seconds: float) -> None:
        self.rows += rows
        if seconds <= 0:
            return
        keep = exp(-0.693147 * seconds / self.half)
        weight = 1 - keep
        # the first values stand for themselves: a mean over the time that has been seen
        self._seconds = self._seconds * keep + weight
        self.rate = rows / seconds if self.rate is None else self.rate + (rows / seconds - self.rate) * weight / self._seconds

    def read(self, total: int | None = None) -> dict:
        """rows, per_second, per_minute, and with a total: share done and seconds left (None while nothing moves)."""
        found = {"rows": self.rows, "per_second": self.rate or 0.0, "per_minute": 60 * (self.rate or 0.0)}
        if total is not None:
            left = max(0, total - self.rows)
            found |= {"share": self.rows / total if total else 1.0, "seconds_left": 0.0 if not left else left / self.rate if self.rate else None}
        return found


class Meter(StreamingQueryListener):
    """Rates of all streaming queries of a session, by name or id: spark.streams.addListener(Meter())."""

    def __init__(self, half: float = 60.0):
        self.half, self.rates, self.names, self.ended = half, {}, {}, {}

    def onQueryStarted(self, event) -> None:
        self.names[event.name or str(event.id)] = str(event.id)
        self.rates.setdefault(str(event.id), Rate(self.half))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rates.setdefault(str(p.id), Rate(self.half)).add(p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def read(self, name: str, total: int | None = None) -> dict:
        return self.rates.get(self.names.get(name, name), Rate(self.half)).read(total)


class BatchMeter:
    """Counts rows as tasks pass them on. `counted` frames may run on while `read` is asked; a task that runs again counts again."""

    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.monotonic, half: float = 60.0):
        self._passed, self._clock = spark.sparkContext.accumulator(0), clock
        self._rate, self._at = Rate(half), clock()

    def counted(self, rows: DataFrame) -> DataFrame:
        passed = self._passed

        def run(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    def read(self, total: int | None = None) -> dict:
        now = self._clock()
        self._rate.add(self._passed.value - self._rate.rows, now - self._at)
        self._at = now
        return self._rate.read(total)
