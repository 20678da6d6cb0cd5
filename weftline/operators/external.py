"""Calls to outside services as a partition-wise map, with retries, a rate limit and a resumable outcome."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.replies import verdict_line
from weftline.functions.text import ANSWER_CUES, slices

RETRIES, BACKOFF_SECONDS, CAP_SECONDS = 3, 8.0, 60.0


class Retryable(RuntimeError):
    """Raised by a service function for failures that may pass: limits, timeouts, server errors."""


def backoff(attempt: int, jitter: float, base: float = BACKOFF_SECONDS, cap: float = CAP_SECONDS) -> float:
    """Seconds before the next attempt; jitter in 0 to 1 stretches it by 0.85 to 1.15."""
    return min(cap, base * 2**attempt * (0.85 + 0.3 * jitter))


def call(
    requests: DataFrame, service: Callable[[str], str], retries: int = RETRIES, per_minute: float | None = None,
    base: float = BACKOFF_SECONDS, parallel: int | None = None, key: str = "_key",
) -> DataFrame:
    """_key, reply, error, attempts for requests (_key, prompt).

    `parallel` partitions work side by side, each within its part of the rate, so that one rate holds for all executors. A request that keeps
    failing gives its error, so that a later run can take up what has no reply (see quota.not_done). Repeated keys are calls of their own.
    """
    rows = requests.select(key, "prompt")
    rows = rows.repartition(parallel) if parallel else rows
    gap = 60.0 * parallel / per_minute if per_minute and parallel else 0.0

    def run(batches):
        due = 0.0
        for batch in batches:
            out = []
            for prompt in batch.column(1).to_pylist():
                reply = error = None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + gap
                    try:
                        reply, error = service(prompt), None
                        break
                    except Retryable as e:
                        error = str(e) or "retryable"
                        if attempt < retries:
                            time.sleep(backoff(attempt, random.random(), base))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                out.append((reply, error, attempt + 1))
            replies, errors, tries = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "reply", "error", "attempts"])

    return rows.mapInArrow(run, f"`{key}` {requests.schema[key].dataType.simpleString()}, reply string, error string, attempts int")


#: Fixed value: characters of the reference answer that a prompt may hold.
REFERENCE_CHARS = 800


def prompt(template: str, limits: dict[str, int] | None = None, **columns: Column) -> Column:
    """The template with each {name} replaced by a column's text (null: empty), cut to limits[name] characters if there is one.

    Of a text put in, braces stay as they are.
    """
    limits = {"reference": REFERENCE_CHARS} | (limits or {})
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and part in columns:
            text = F.coalesce(columns[part].cast("string"), F.lit(""))
            parts.append(F.substring(text, 1, limits[part]) if part in limits else text)
        else:
            parts.append(F.lit("{" + part + "}" if i % 2 else part))
    return F.concat(*parts)


def distinct_models(student: tuple[str, str], tutor: tuple[str, str]) -> None:
    """Refuses two agents that are one: the same model at the same base URL. Each is (base URL, model)."""
    same = [a.strip().rstrip("/").lower() == b.strip().rstrip("/").lower() for a, b in [(student[0], tutor[0])]]
    if all(same) and student[1].strip() == tutor[1].strip():
        raise ValueError("student and tutor must be different models")


def call_with_rounds(requests: DataFrame, service: Callable[[str], str], store, waits: tuple[float, ...] = (120.0, 300.0), wait=time.sleep, **options) -> DataFrame:
    """_key, reply, error, stage, error_history: `call`, and what failed called again after each of `waits`. One row for each request, whether keys repeat or not.

    error_history lists each failed round (attempt from 0, error). What fails in all rounds has the stage
    max_retry. `store` keeps a round's outcome, so that no call is repeated when it is read again. The caller's process waits
    between rounds; where it may not live as long, queue.RequestQueue keeps rounds in a table.
    """
    history = "array<struct<attempt:int,error:string>>"
    # requests are told apart by numbers of their own, fixed by being stored
    every = store(requests.select("_key", "prompt").withColumn("_request", F.monotonically_increasing_id()))
    open_ = every.withColumn("error_history", F.array().cast(history))
    done = []
    for attempt, seconds in enumerate((0.0, *waits)):
        if attempt:
            if open_.isEmpty():
                break
            wait(seconds)
        outcome = store(call(open_, service, key="_request", **options).drop("attempts"))
        failed = F.struct(F.lit(attempt).alias("attempt"), F.col("error"))
        joined = outcome.join(open_, "_request")
        joined = joined.withColumn("error_history", F.when(F.col("error").isNull(), F.col("error_history")).otherwise(F.concat("error_history", F.array(failed))))
        done.append(joined.where("error IS NULL").select("_key", "reply", "error", F.lit("done").alias("stage"), "error_history"))
        open_ = joined.where("error IS NOT NULL").select("_key", "prompt", "_request", "error_history")
    last = F.element_at("error_history", -1)["error"]
    done.append(open_.select("_key", F.lit(None).cast("string").alias("reply"), last.alias("error"), F.lit("max_retry").alias("stage"), "error_history"))
    return reduce(DataFrame.unionByName, done)


#: Analyses at once, seconds that one waits for its turn, and what is said of one that had none.
ANALYSES, TURN_SECONDS = 3, 2.0
FULL, NO_REASON = "Analiz kuyruğu dolu", "Analiz başarısız"


def mode_note(mode: str | None, process: str | None, title: str | None) -> str:
    """What the model is told about the exam's mode and the student's active window (fixed texts)."""
    note = "\nNot: Bu kodlama sınavıdır. IDE ve dokümantasyon siteleri normaldir." if mode == "coding" else ""
    if process or title:
        note += f"\nEk bağlam: aktif pencere='{title or ''}', süreç='{process or ''}'."
    return note


def analysed(screens: DataFrame, service: Callable[[str, str], str], at_once: int = ANALYSES, turn: float | None = TURN_SECONDS, clock=time.monotonic) -> DataFrame:
    """event_id, suspicious, verdict, reason, raw of screenshots (event_id, screenshot, mode, active_process, window_title).

    `service(image, note)` gets the image in base 64 without its data URL's head, and the note. No more than `at_once` calls run
    side by side in all executors. One that has not had its turn within `turn` seconds of the batch's arrival, or fails, is an error
    that is never clean; with `turn` None all wait for theirs.
    """

    def run(batches):
        began = clock()
        for batch in batches:
            out = []
            for shot, mode, process, title in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if turn is not None and clock() - began > turn:
                    out.append((None, FULL))
                    continue
                try:
                    image = (shot or "").split(",", 1)[1] if "," in (shot or "") else shot or ""
                    out.append(((service(image, mode_note(mode, process, title)) or "").strip(), None))
                except Exception as e:
                    out.append((None, str(e) or NO_REASON))
            raw, error = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(error, pa.string())], names=["event_id", "raw", "error"])

    kind = screens.schema["event_id"].dataType.simpleString()
    rows = screens.select("event_id", "screenshot", "mode", "active_process", "window_title").repartition(at_once)
    said = rows.mapInArrow(run, f"event_id {kind}, raw string, error string")
    suspicious, verdict, reason = verdict_line(F.col("raw"))
    fine = F.col("error").isNull()
    return said.select(
        "event_id", (fine & F.coalesce(suspicious, F.lit(False))).alias("suspicious"), F.when(fine, verdict).otherwise("HATA").alias("verdict"),
        F.when(fine, reason).otherwise(F.col("error")).alias("reason"), "raw",
    )


def _reasons(reply: str, tutor: bool, closing: bool, least: int) -> list[str]:
    """The gates of validate.reply_reasons, for a reply that has just come."""
    clean = " ".join(re.sub(r"[^\w\s]", " ", reply.lower()).split())
    found = ["short_or_empty"] if len(reply.strip()) < max(1, least) else []
    if tutor and "?" not in reply and not closing:
        found.append("no_question")
    if tutor and any(cue in clean for cue in ANSWER_CUES):
        found.append("direct_answer")
    return found


def simulate(
    candidates: DataFrame, student: Callable[[str, list], str], tutor: Callable[[str, list], str], max_turns: int,
    min_turns: int = 0, retries: int = 0, least: int = 0,
) -> DataFrame:
    """Adds messages, attempts and error to candidates (_key, source_question): two agents speak in turn, `max_turns` times each.

    With `least`, replies pass the gates of validate.reply_reasons or are asked for again, `retries` times; a
    reply that never passes ends the dialogue with an error. `attempts` is every reply that came, for validate.qc_flags.
    """
    new = ("messages", "attempts", "error")
    kept = [c for c in candidates.columns if c not in new]
    schema = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in kept)

    def talk(question):
        said: list[dict] = []
        tried: list[dict] = []
        for turn in range(1, max_turns + 1):
            for role, agent in (("user", student), ("assistant", tutor)):
                reasons: list[str] = []
                for attempt in range(retries + 1):
                    reply = agent(question, said)
                    tried.append({"turn": turn, "role": role, "attempt": attempt, "reply": reply})
                    reasons = _reasons(reply, role == "assistant", turn == max_turns and turn >= min_turns, least) if least else []
                    if not reasons:
                        break
                if reasons:
                    return said, tried, f"{'tutor' if role == 'assistant' else 'student'}_reply_quality_error: {','.join(reasons)}"
                said.append({"role": role, "content": reply.strip() if least else reply})
        return said, tried, None

    text, number = pa.string(), pa.int32()
    message = pa.struct([("role", text), ("content", text)])
    attempt = pa.struct([("turn", number), ("role", text), ("attempt", number), ("reply", text)])
    kinds = (pa.list_(message), pa.list_(attempt), text)

    def run(batches):
        for batch in batches:
            questions = batch.column("source_question")
            # the other columns stay as they are
            for low, high in slices(questions):
                talks = [talk(q) for q in questions.slice(low, high - low).to_pylist()]
                made = [pa.array([t[i] for t in talks], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *made], names=[*kept, *new])

    added = "messages array<struct<role:string,content:string>>, attempts array<struct<turn:int,role:string,attempt:int,reply:string>>, error string"
    return candidates.select(*kept).mapInArrow(run, f"{schema}, {added}")


def failures(outcomes: DataFrame, stage: str) -> DataFrame:
    """The failed calls with the stage in which they broke off."""
    return outcomes.where("error IS NOT NULL").select("_key", F.lit(stage).alias("stage"), "error", "attempts")
