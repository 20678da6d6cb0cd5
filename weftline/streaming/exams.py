"""Live exams: the clock that ends them, pairing codes, focus episodes and counters.

Operators whose outcome depends on order hold what comes in a list until the watermark has passed it, and then take it
in order of time and event_id: the result is that of the batch operators, in whatever order messages arrive within `late`.
Time is the events' own; a timer ends what ends by itself (an exam's minutes, a code's life, an episode), and every state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators import sessions
from weftline.streaming.live import LATE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Takes each key's events in order of time once the watermark is past them.

    Subclasses name the fields of their events after `us` and `event_id`, and those of their output; `begin` makes their
    state, `load` reads it once before a key's due events, and `save` writes what has changed after them; `take` treats an event,
    `until` says when something is due by itself (microseconds; None: nothing) and `ring` does it.
    """

    fields: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    out: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        wide = ", ".join(f"{n} {t}" for n, t in zip(("us", "event_id", *self.fields), ("long", "string", *self.types), strict=True))
        self.waiting = handle.getListState("waiting", wide)
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None: ...

    def load(self) -> None: ...

    def save(self) -> None: ...

    def take(self, key: tuple, event: dict) -> Iterator[tuple]:
        return iter(())

    def until(self) -> int | None:
        return None

    def ring(self, key: tuple, us: int) -> Iterator[tuple]:
        return iter(())

    def _wake(self, us: int) -> None:
        # a timer rings once the watermark is past its millisecond
        self.handle.registerTimer(us // 1000)

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in self.out.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["us", "event_id", *self.fields]
        new = [tuple(None if v is pd.NA or v != v else v for v in r) for frame in rows for r in frame[names].astype(object).itertuples(index=False, name=None)]
        self.waiting.appendList([(int(r[0]), *r[1:]) for r in new])
        self._wake(min(int(r[0]) for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        names = ("us", "event_id", *self.fields)
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] < now), key=lambda r: (r[0], str(r[1])))
        rest = [r for r in held if r[0] >= now]
        out: list[tuple] = []
        self.load()
        for r in due:
            while (end := self.until()) is not None and end <= r[0]:
                out += self.ring(key, end)
            out += self.take(key, dict(zip(names, r, strict=True)))
        while (end := self.until()) is not None and end < now:
            out += self.ring(key, end)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.save()
        following = [r[0] for r in rest] + [end for end in (self.until(),) if end is not None]
        if following:
            self._wake(min(following))
        return self._frame(out)


class Room(InOrder):
    """One exam at a time, and the codes that pair a student's devices while it runs."""

    fields = ("action", "exam_id", "minutes", "student_id", "code")
    types = ("string", "string", "double", "string", "string")
    out = "room string, event_id string, kind string, exam_id string, student_id string, us long, reason string"

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.exam = handle.getValueState("exam", "exam_id string, started long, ends long")
        self.codes = handle.getMapState("codes", "code string", "student_id string, exam_id string, ends long")

    def load(self) -> None:
        self.running = tuple(self.exam.get()) if self.exam.exists() else None
        held = [(k[0], tuple(v)) for k, v in self.codes.iterator()] if self.codes.exists() else []
        # all live equally long: the first made is the first to go
        self.living = dict(sorted(held, key=lambda x: x[1][2]))
        self.stored = (self.running, dict(self.living))

    def save(self) -> None:
        exam, codes = self.stored
        if self.running != exam:
            self.exam.update(self.running) if self.running else self.exam.clear()
        for code in codes.keys() - self.living.keys():
            self.codes.removeKey((code,))
        for code, value in self.living.items():
            if codes.get(code) != value:
                self.codes.updateValue((code,), value)

    def until(self) -> int | None:
        first = next(iter(self.living.values()), None)
        ends = ([first[2]] if first else []) + ([self.running[2]] if self.running and self.running[2] is not None else [])
        return min(ends, default=None)

    def _over(self, key: tuple, us: int, reason: str, event_id: str | None = None) -> Iterator[tuple]:
        if self.running:
            yield key[0], event_id, "ended", self.running[0], None, us, reason
        # codes belong to the exam that ran when they were made
        self.running, self.living = None, {}

    def ring(self, key: tuple, us: int) -> Iterator[tuple]:
        while self.living and next(iter(self.living.values()))[2] <= us:
            del self.living[next(iter(self.living))]
        if self.running and self.running[2] is not None and self.running[2] <= us:
            yield from self._over(key, us, "duration_expired")

    def take(self, key: tuple, event: dict) -> Iterator[tuple]:
        us, event_id, action = event["us"], event["event_id"], event["action"]
        if action == "start":
            yield from self._over(key, us, "next_start", event_id)
            ends = None if event["minutes"] is None else us + int(max(0.0, event["minutes"]) * 60e6)
            self.running = (event["exam_id"], us, ends)
            yield key[0], event_id, "started", event["exam_id"], None, us, None
        elif action == "stop":
            yield from self._over(key, us, "manual", event_id)
        elif action == "duration" and self.running:
            ends = max(us, self.running[1] + int(max(0.0, event["minutes"] or 0.0) * 60e6))
            self.running = (*self.running[:2], ends)
        elif action == "pair":
            exam = self.running and self.running[0]
            if self.running:
                self.living.pop(event["code"], None)
                self.living[event["code"]] = (event["student_id"], exam, us + sessions.PAIRING_SECONDS * 1_000_000)
            yield key[0], event_id, "code_made" if self.running else "refused", exam, event["student_id"], us, None if self.running else "no_exam"
        elif action == "exchange":
            yield self._exchanged(key, event)

    def _exchanged(self, key: tuple, event: dict) -> tuple:
        student, made_in, _ = known = self.living.pop(event["code"], (None, None, None))
        other = event["exam_id"] is not None and event["exam_id"] != made_in
        reason = "unknown_or_expired" if known[2] is None else "other_exam" if other or not self.running else None
        return key[0], event["event_id"], "refused" if reason else "accepted", self.running and self.running[0], student, event["us"], reason


def _ordered(events: DataFrame, key: str, kind: InOrder, late: str) -> DataFrame:
    """The rows that a processor makes of the events (key, ts, event_id and its fields), with `us` as the timestamp `at`."""
    names = (key, "ts", "event_id", *kind.fields)
    fine = events.where(F.col("ts").isNotNull()).select(*names).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    made = fine.groupBy(key).transformWithStateInPandas(statefulProcessor=kind, outputStructType=kind.out, outputMode="append", timeMode="eventTime")
    return made.withColumn("at", F.timestamp_micros("us")).drop("us")


def rooms(events: DataFrame, late: str = LATE) -> DataFrame:
    """room, event_id, kind, exam_id, student_id, reason, at: what happens in each room, from its commands and its students' requests.

    events: room, ts, event_id, action (start, stop, duration, pair, exchange), exam_id, minutes, student_id, code.
    kind: started; ended, by `manual` stop, `next_start` or `duration_expired`, the last without any event of the room;
    code_made; accepted, once for each code within its life and while its exam runs; refused, with the reason. A code
    made again while it lives is the new one.
    """
    return _ordered(events, "room", Room(), late)


class Focus(InOrder):
    """Episodes in which a student's window has no focus; a timer waits whether it comes back at once."""

    fields = ("focused",)
    types = ("boolean",)
    out = "student_id string, kind string, since long, us long"
    seconds = sessions.UNFOCUS_SECONDS

    def __init__(self, idle: int):
        self.idle = idle

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.away = handle.getValueState("away", "since long, told boolean")

    def load(self) -> None:
        self.lost = self.stored = tuple(self.away.get()) if self.away.exists() else None

    def save(self) -> None:
        if self.lost != self.stored:
            self.away.update(self.lost) if self.lost else self.away.clear()

    def until(self) -> int | None:
        if self.lost is None:
            return None
        since, told = self.lost
        return since + (self.idle if told else self.seconds) * 1_000_000

    def ring(self, key: tuple, us: int) -> Iterator[tuple]:
        since, told = self.lost
        yield key[0], "lapsed" if told else "open", since, us
        self.lost = None if told else (since, True)

    def take(self, key: tuple, event: dict) -> Iterator[tuple]:
        if event["focused"]:
            if self.lost and self.lost[1]:
                yield key[0], "closed", self.lost[0], event["us"]
            self.lost = None
        elif self.lost is None:
            self.lost = (event["us"], False)


def unfocus_episodes(focus: DataFrame, late: str = LATE, idle: int = 7200) -> DataFrame:
    """student_id, kind, since, at of unfocused spans that last long enough, from (student_id, ts, event_id, focused).

    An episode is `open` once the watermark is UNFOCUS_SECONDS past its start, `closed` when focus comes back, and `lapsed`
    `idle` seconds after it was told of, without a word; its state then goes, and a further report of lost focus opens a new one. A span
    that ends sooner gives nothing.
    """
    return _ordered(focus, "student_id", Focus(idle), late).withColumn("since", F.timestamp_micros("since"))


def _told_apart(events: DataFrame, late: str) -> DataFrame:
    """The events with `id`, each once within the watermark; those without an id are told apart by time, reason and student."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.coalesce("event_id", F.concat_ws("-", F.unix_micros("ts").cast("string"), "reason", F.coalesce("student_id", F.lit("x"))))
    return events.withColumn("id", own).withWatermark("ts", late).dropDuplicatesWithinWatermark(["exam_id", "id"])


def counters(events: DataFrame, span: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """exam_id, day, total, alerts (update mode): events and alerts of each exam, each event once although it comes again.

    events: event_id, exam_id, student_id, reason, ts, status, suspicious. A repeated event is known for `late` after its first
    time; the counts of a span end with it. Partial sums are made where events are read.
    """
    bad = F.coalesce(F.col("status") == "suspicious", F.lit(False)) | F.coalesce("suspicious", F.lit(False))
    sums = _told_apart(events, late).groupBy("exam_id", F.window("ts", span).alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("alerts"))
    return sums.select("exam_id", F.col("w.start").alias("day"), "total", "alerts")


def alert_counts(events: DataFrame, span: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """exam_id, student_id, day, alerts (update mode), by the batch rule: direct alerts, confirmed suspicions of the exam itself, client alerts."""
    counts = (F.col("route") == "direct_alert") | ((F.col("status") == "suspicious") & (F.col("exam_id") == F.col("current_exam"))) | (F.col("kind") == "client_alert")
    sums = _told_apart(events, late).groupBy("exam_id", "student_id", F.window("ts", span).alias("w")).agg(F.count_if(F.coalesce(counts, F.lit(False))).alias("alerts"))
    return sums.select("exam_id", "student_id", F.col("w.start").alias("day"), "alerts")
