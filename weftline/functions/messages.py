"""Functions on a dialogue's messages: array<struct<role string, content string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Words that a student of the profile is expected to use.
PROFILE_HINTS = {
    "FAST": ("bence", "mantikli", "haklisin", "aslinda"),
    "MEM": ("tanim", "tanimda", "emin degilim"),
    "SLOW": ("sanirim", "adim adim", "bir dakika", "tekrar bakayim", "emin degilim"),
}


def _text(part: Column) -> Column:
    return F.coalesce(part, F.lit(""))


def content_hash(messages: Column) -> Column:
    """SHA-1 over normalised roles and contents; null for a null list."""
    parts = F.transform(messages, lambda m: F.concat(T.normalise_space(m["role"]), F.lit("\n"), T.normalise_space(m["content"])))
    return F.sha1(F.array_join(parts, "\n---\n"))


def fingerprint(messages: Column) -> Column:
    """SHA-1 over roles and sanitised contents."""
    parts = F.transform(messages, lambda m: F.concat(_text(m["role"]), F.lit("::"), T.sanitise(m["content"])))
    return F.sha1(F.array_join(parts, "||"))


def joined(messages: Column, role: str | None = None) -> Column:
    """The contents, of one role if given, joined by spaces."""
    kept = F.filter(messages, lambda m: m["role"] == role) if role else messages
    return F.array_join(F.transform(kept, lambda m: _text(m["content"])), " ")


def words(messages: Column) -> Column:
    return T.tokens(joined(messages))


def profile_issue(profile: Column, messages: Column) -> Column:
    """profile_hint_missing:P if a known profile's student uses none of its words, else null."""
    said = T.sanitise(joined(messages, "user"))
    issue = F.lit(None).cast("string")
    for name, hints in PROFILE_HINTS.items():
        hit = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(said, h))
        issue = F.when((profile == name) & ~hit, F.lit(f"profile_hint_missing:{name}")).otherwise(issue)
    return issue


def render(messages: Column, colon: bool = False) -> Column:
    """The dialogue as text: one line a message, or with colons, blank lines and a name for unknown roles."""
    if colon:
        name = lambda r: F.when(r == "user", "Öğrenci").when(r == "assistant", "Tutor").otherwise("Unknown")
        return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), name(m["role"]), F.lit("]: "), _text(m["content"]))), "\n\n")
    name = lambda r: F.when(r == "user", "Öğrenci").otherwise("Tutor")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), name(m["role"]), F.lit("] "), _text(m["content"]))), "\n")


def with_system(system: Column, messages: Column) -> Column:
    """The system message in front, if there is one."""
    first = F.struct(F.lit("system").alias("role"), system.alias("content"))
    return F.when(T.is_filled(system), F.concat(F.array(first), messages)).otherwise(messages)


def remapped(messages: Column) -> Column:
    """Roles of the human/gpt convention as user/assistant."""
    role = lambda r: F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)
    return F.transform(messages, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")))


def system_merged(messages: Column) -> Column:
    """For templates without a system role: its text goes in front of the first user message."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: _text(m["content"])), "\n\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    merged = F.transform(
        rest,
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when((i + 1 == first) & (system != ""), F.concat(system, F.lit("\n\n"), _text(m["content"]))).otherwise(m["content"]).alias("content"),
        ),
    )
    return merged


def chat_text(messages: Column) -> Column:
    """The plain ChatML form."""
    part = lambda m: F.concat(F.lit("<|im_start|>"), _text(m["role"]), F.lit("\n"), _text(m["content"]), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, part), "")


def trimmed(messages: Column, last: int) -> tuple[Column, Column]:
    """(messages, trimmed?): the first message and the last ones, if more than 1 + last."""
    long = (F.size(messages) > 1 + last) & F.lit(last > 0)
    cut = F.concat(F.slice(messages, 1, 1), F.slice(messages, -last, last)) if last > 0 else messages
    return F.when(long, cut).otherwise(messages), long
