"""Validators of dialogue records: each gives the array of its reasons, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.dialogues import PROFILES

ROLES = ("user", "assistant")


def _when(condition: Column, reason: str | Column) -> Column:
    return F.when(condition, F.lit(reason) if isinstance(reason, str) else reason)


def _reasons(*parts: Column) -> Column:
    """The reasons that hold, from single ones (string or null)."""
    return F.array_compact(F.array(*parts))


def _numbered(name: str, i: Column) -> Column:
    return F.concat(F.lit(f"{name}_"), i.cast("string"))


def raw_reasons(messages: Column, system: Column, key: Column | None = None, profile: Column | None = None, content_reason: str = "invalid_content") -> Column:
    """Reasons of an unconverted record. Message reasons follow only if the list itself is usable."""
    head = []
    if key is not None:
        head.append(_when(~T.is_filled(key), "invalid_key"))
    if profile is not None:
        head.append(_when(~F.coalesce(profile.isin(*PROFILES), F.lit(False)), "invalid_profile"))
    head.append(_when(~T.is_filled(system), "invalid_system"))
    listed = messages.isNotNull() & (F.size(messages) >= 2)
    head.append(_when(~F.coalesce(listed, F.lit(False)), "invalid_messages_list"))

    def of(m: Column, i: Column) -> Column:
        unknown = ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))
        return _reasons(
            _when(m.isNull(), _numbered("message_not_object", i)),
            _when(m.isNotNull() & unknown, _numbered("invalid_role", i)),
            _when(m.isNotNull() & ~T.is_filled(m["content"]), _numbered(content_reason, i)),
        )

    tail = F.when(listed, F.flatten(F.transform(messages, of))).otherwise(F.array().cast("array<string>"))
    return F.concat(_reasons(*head), tail)


def _expected(i: Column) -> Column:
    return F.when(i == 0, "system").when(i % 2 == 1, "user").otherwise("assistant")


def chatml_reasons(messages: Column) -> Column:
    """Structure of a converted record: system, then user and assistant in turn, assistant last, nothing blank.

    Turns are checked up to the first that breaks the order; blank contents count up to there.
    """
    size = F.size(messages)
    usable = messages.isNotNull() & (size >= 3)
    numbered = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), T.is_filled(m["content"]).alias("filled")))
    wrong = F.filter(numbered, lambda x: (x["i"] > 0) & ~F.coalesce(x["role"] == _expected(x["i"]), F.lit(False)))
    stop = F.coalesce(F.get(wrong, F.lit(0))["i"], size)
    per = F.flatten(
        F.transform(
            F.filter(numbered, lambda x: x["i"] <= stop),
            lambda x: _reasons(
                _when(~x["filled"], _numbered("chatml_empty_content", x["i"])),
                _when((x["i"] == 0) & ~F.coalesce(x["role"] == "system", F.lit(False)), "system_role_invalid"),
                _when((x["i"] > 0) & (x["i"] == stop), _numbered("not_alternating", x["i"])),
            ),
        )
    )
    role = lambda i: F.coalesce(F.get(messages, i)["role"], F.lit(""))
    head = _reasons(
        _when(role(F.lit(0)) != "system", "first_not_system"),
        _when(role(F.lit(1)) != "user", "second_not_user"),
        _when(role(size - 1) != "assistant", "last_not_assistant"),
    )
    return F.when(F.coalesce(usable, F.lit(False)), F.concat(head, per)).otherwise(F.array(F.lit("invalid_chatml_messages")))


def structure_reasons(messages: Column) -> Column:
    """The shorter check before a split: what comes first in the list of turns ends it, blank or out of order."""
    numbered = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), T.is_filled(m["content"]).alias("filled")))
    bad = F.filter(numbered, lambda x: ~x["filled"] | ((x["i"] > 0) & ~F.coalesce(x["role"] == _expected(x["i"]), F.lit(False))))
    first = F.get(bad, F.lit(0))
    role = lambda i: F.coalesce(F.get(messages, i)["role"], F.lit(""))
    return _reasons(
        _when(role(F.lit(0)) != "system", "no_system_prefix"),
        _when(role(F.lit(1)) != "user", "first_after_system_not_user"),
        _when(~first["filled"], "empty_content"),
        _when(first["filled"], "role_not_alternating"),
        _when(role(F.size(messages) - 1) != "assistant", "last_not_assistant"),
    )


def generation_issues(messages: Column, min_turns: Column) -> Column:
    """Issues of a freshly generated dialogue, as codes with 1-based message numbers."""
    numbered = F.transform(messages, lambda m, i: F.struct((i + 1).alias("i"), m["role"].alias("role"), F.coalesce(T.normalise_space(m["content"]), F.lit("")).alias("content")))
    size = F.size(messages)

    def picked(condition, name):
        return F.transform(F.filter(numbered, condition), lambda x: _numbered(name, x["i"]))

    expected = lambda i: F.when(i % 2 == 1, "user").otherwise("assistant")
    found = F.concat(
        picked(lambda x: x["content"].isin("", "..."), "empty_content"),
        _reasons(_when(F.get(messages, F.lit(0))["role"] != "user", "first_not_user"), _when(F.get(messages, size - 1)["role"] != "assistant", "last_not_assistant")),
        picked(lambda x: x["role"] != expected(x["i"]), "unexpected_role"),
        _reasons(_when(F.floor(size / 2) < min_turns, "too_few_turns")),
        picked(lambda x: (x["role"] == "assistant") & (x["i"] < size) & ~T.asks(x["content"]), "no_question"),
    )
    return F.when(F.coalesce(size, F.lit(0)) > 0, found).otherwise(F.array(F.lit("no_messages")))


def reply_flags(reply: Column, role: Column, turn: Column, max_turns: Column, min_turns: Column, least: int = 10) -> Column:
    """What is wrong with one generated reply, null if nothing: short_or_empty, no_question or direct_answer.

    A tutor must ask, but for the last turn of a dialogue that has had its least number of turns.
    """
    tutor = role == "assistant"
    exempt = (turn >= max_turns) & (turn >= min_turns)
    return (
        F.when(T.is_short(reply, least), "short_or_empty")
        .when(tutor & ~T.asks(reply) & ~exempt, "no_question")
        .when(tutor & T.gives_answer(reply), "direct_answer")
    )


def reply_reasons(reply: Column, role: Column, turn: Column, max_turns: Column, min_turns: Column, least: int = 10) -> Column:
    """All that is wrong with one generated reply, in order: short_or_empty, no_question, direct_answer."""
    tutor = F.coalesce(role == "assistant", F.lit(False))
    return _reasons(
        _when(F.coalesce(T.is_short(reply, least), F.lit(True)), "short_or_empty"),
        _when(tutor & ~T.asks(reply) & ~_closing(turn, max_turns, min_turns), "no_question"),
        _when(tutor & T.gives_answer(reply), "direct_answer"),
    )


def _closing(turn: Column, max_turns: Column, min_turns: Column) -> Column:
    return (turn == max_turns) & (turn >= min_turns)


#: Counters of what was found wrong with replies, by its reason.
DETECTED = {"short_or_empty": "short_or_empty_reply_detected", "no_question": "tutor_no_question_detected", "direct_answer": "tutor_direct_answer_detected"}


def qc_flags(attempts: DataFrame, least: int = 10) -> DataFrame:
    """Per dialogue (_key) the counters of its replies' quality gates, and `error` of the first reply without a good attempt.

    attempts: _key, turn (from 1), role, attempt (from 0), reply, max_turns, min_turns. Every attempt that
    something is wrong with is a retry; of a reply, attempts end with the first good one. The error names
    the reply's speaker and the reasons of its last attempt.
    """
    judged = attempts.withColumn("_r", reply_reasons(F.col("reply"), F.col("role"), F.col("turn"), F.col("max_turns"), F.col("min_turns"), least))
    tutor, bad = F.col("role") == "assistant", F.size("_r") > 0
    closing = tutor & ~T.asks(F.col("reply")) & _closing(F.col("turn"), F.col("max_turns"), F.col("min_turns"))
    replies = judged.groupBy("_key", "turn", "role").agg(
        F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"), F.count_if(closing).alias("closing"), F.max_by(F.array_join("_r", ","), "attempt").alias("last"),
        *(F.count_if(F.array_contains("_r", r)).alias(name) for r, name in DETECTED.items()),
    )
    name = F.when(tutor, "tutor").otherwise("student")
    place = F.struct("turn", tutor.alias("late"))
    lost = F.col("good") == 0
    return replies.groupBy("_key").agg(
        F.coalesce(F.sum(F.when(~tutor, F.col("bad"))), F.lit(0)).alias("student_retry_count"),
        F.coalesce(F.sum(F.when(tutor, F.col("bad"))), F.lit(0)).alias("tutor_retry_count"),
        *(F.sum(n).alias(n) for n in DETECTED.values()),
        F.sum("closing").alias("tutor_closing_without_question"),
        F.min_by(F.when(lost, F.concat(name, F.lit("_reply_quality_error: "), "last")), F.when(lost, place)).alias("error"),
    )


def quarantine(records: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): records without and with reasons; the invalid ones list each reason once, sorted."""
    valid = records.where(F.size(reasons) == 0).drop(reasons)
    return valid, records.where(F.size(reasons) > 0).withColumn(reasons, F.array_sort(F.array_distinct(reasons)))


def histogram(records: DataFrame, reasons: str = "reasons", distinct: bool = True) -> DataFrame:
    """reason, records (or occurrences) of all records."""
    listed = F.array_distinct(reasons) if distinct else F.col(reasons)
    return records.select(F.explode(listed).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def assert_none(records: DataFrame, reasons: str = "reasons", key: str = "_key") -> DataFrame:
    """The records, or an error that names the first invalid one when the frame is evaluated."""
    told = F.concat(F.lit("invalid record "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.array_join(reasons, ","))
    return records.withColumn("_ok", F.when(F.size(reasons) > 0, F.raise_error(told)).otherwise(True)).where("_ok").drop("_ok")
