"""Live operators on session events: votes, timeouts, presence, throttling and silence.

Stateful operators keep a few values per student or address, in the state store. All of them measure time
by the events themselves: a watermark trails the newest event by `late`, events behind it are dropped, and
every state has a timer after which it goes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import sessions

#: Columns of an event stream.
EVENTS = (
    "event_id string, exam_id string, student_id string, reason string, mode string, ts timestamp, tab_url string, tab_title string, "
    "active_process string, window_title string"
)
LATE = "10 seconds"


def received(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of JSON texts (value) as they arrive; an event must have its id, student and time."""
    parsed = lines.select("value", F.from_json("value", EVENTS).alias("e"))
    good = F.coalesce(F.col("e.event_id").isNotNull() & F.col("e.student_id").isNotNull() & F.col("e.ts").isNotNull(), F.lit(False))
    return parsed.where(good).select("e.*"), parsed.where(~good).select("value")


def routed(events: DataFrame) -> DataFrame:
    """Routing has no state: the batch rule serves."""
    return sessions.routed(events)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """The rows with a watermark on ts and `_us`, the same time in microseconds, which no session time zone changes."""
    return rows.withWatermark("ts", late).withColumn("_us", F.unix_micros("ts"))


def _expire(state: GroupState, us: int, seconds: float) -> None:
    """Sets the timer to so long after an event's time."""
    state.setTimeoutTimestamp(max(int(us // 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))


def _in_order(frames) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["_us", "event_id"])


def votes(results: DataFrame, idle: str = "2 hours", late: str = LATE) -> DataFrame:
    """event_id, exam_id, student_id, confirmed for voting results (exam_id, student_id, ts, event_id, suspicious), in order of time in each batch.

    A student's votes are forgotten when nothing is heard for `idle`.
    """

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        frame = _in_order(frames)
        out = []
        for vote in frame["suspicious"].fillna(False).astype(bool):
            held = [*held, int(vote)][-sessions.VOTES :]
            out.append(bool(vote and len(held) >= sessions.VOTES and sum(held) >= sessions.VOTES_NEEDED))
        state.update((held,))
        _expire(state, frame["_us"].iloc[-1], pd.Timedelta(idle).total_seconds())
        yield frame[["event_id", "exam_id", "student_id"]].assign(confirmed=out)

    return _timed(results, late).groupBy("exam_id", "student_id").applyInPandasWithState(
        run, "event_id string, exam_id string, student_id string, confirmed boolean", "votes array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )


def timed_out(events: DataFrame, results: DataFrame, late: str = LATE, seconds: int = sessions.TIMEOUT_SECONDS) -> DataFrame:
    """Events with their result, or null once the time is over by both watermarks (an outer interval join)."""
    e = events.withWatermark("ts", late)
    r = results.withColumnRenamed("event_id", "_event").withWatermark("done_at", late)
    near = (F.col("event_id") == F.col("_event")) & (F.col("done_at") >= F.col("ts")) & (F.col("done_at") <= F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return e.join(r, near, "leftOuter").drop("_event")


def presence(events: DataFrame, seconds: int = sessions.STALE_SECONDS, late: str = LATE) -> DataFrame:
    """student_id, status, at: each change of a student's presence from (student_id, ts, event_id, state active/left).

    An active student turns idle once the watermark is so long past the last report, whose time `at` then is.
    State goes with the same timer, whoever it is of: a report after it counts as a change.
    """

    def run(key, frames, state: GroupState):
        before, last = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            if before == "active":
                yield pd.DataFrame({"student_id": [key[0]], "status": ["idle"], "us": [last]})
            return
        out = []
        for row in _in_order(frames).itertuples(index=False, name=None):
            us, now = row[0], row[2]
            if now != before:
                out.append((key[0], now, us))
            before, last = now, us
        state.update((before, int(last)))
        _expire(state, last, seconds)
        yield pd.DataFrame(out, columns=["student_id", "status", "us"])

    changes = _timed(events, late).select("_us", "event_id", "state", "student_id", "ts").groupBy("student_id").applyInPandasWithState(
        run, "student_id string, status string, us long", "status string, us long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return changes.select("student_id", "status", F.timestamp_micros("us").alias("at"))


def throttled(attempts: DataFrame, late: str = LATE) -> DataFrame:
    """event_id, addr, blocked for attempts (addr, ts, event_id, flag: right code); state goes two minutes after the last attempt."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        frame = _in_order(frames)
        out = []
        for us, right in zip(frame["_us"], frame["flag"], strict=True):
            t = us / 1e6
            held = [x for x in held if x >= t - sessions.THROTTLE_SECONDS]
            stop = len(held) >= sessions.THROTTLE_ATTEMPTS
            out.append(stop)
            if not stop:
                held = [] if right else [*held, t]
        state.update((held,))
        _expire(state, frame["_us"].iloc[-1], 2 * sessions.THROTTLE_SECONDS)
        yield frame[["event_id", "addr"]].assign(blocked=out)

    return _timed(attempts, late).groupBy("addr").applyInPandasWithState(
        run, "event_id string, addr string, blocked boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def report_gaps(events: DataFrame, seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """Reports per student and tumbling window, once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy("student_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def progress(query) -> dict:
    """Rows in, rows a second and batches of a running query."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond")}
