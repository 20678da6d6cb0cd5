"""Parsing of model replies: JSON objects inside text, and labelled verdict lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import text as T


#: What matters for nesting: whole strings, a string that never ends, and braces.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}]', re.S)


def _balanced(text: str, start: int) -> int:
    """End of the object that opens at `start`, or -1. Braces inside strings do not count."""
    depth = 0
    for token in _TOKENS.finditer(text, start):
        if token[0] == '"':
            return -1
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if depth == 0:
            return token.end()
    return -1


def _unfenced(text: str, anywhere: bool) -> str:
    if not (anywhere and "```" in text or text.startswith("```")):
        return text
    for part in (p.strip() for p in text.split("```")):
        body = part[4:].strip() if part.startswith("json") else part
        if body.startswith("{") if anywhere else "{" in body and "}" in body:
            return body
    return text


def find_json(raw: str | None, lenient: bool = False) -> str | None:
    """The first balanced JSON object in a reply, fenced or not.

    Without one: null, or with `lenient` the whole trimmed reply.
    """
    text = _unfenced((raw or "").strip(), lenient)
    start = text.find("{")
    end = _balanced(text, start) if start >= 0 else -1
    return text[start:end] if end > 0 else text if lenient else None


def _found(raw: pa.Array, lenient: bool) -> pa.Array:
    return T.by_slices(raw, lambda part: pa.array([find_json(r, lenient) for r in part.to_pylist()], pa.string()), pa.string())


@F.arrow_udf(StringType())
def json_object(raw: pa.Array) -> pa.Array:
    """The first balanced JSON object of each reply, null if there is none."""
    return _found(raw, False)


@F.arrow_udf(StringType())
def json_object_or_text(raw: pa.Array) -> pa.Array:
    """The first balanced JSON object of each reply, the trimmed reply if there is none."""
    return _found(raw, True)


def outermost_braces(raw: Column) -> Column:
    """From the first opening to the last closing brace; the trimmed text if they are not in that order."""
    text = F.btrim(F.coalesce(raw, F.lit("")))
    start, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    end = F.length(text) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substr(text, start, end - start + 1)).otherwise(text)


def verdict_line(raw: Column) -> tuple[Column, Column, Column]:
    """(suspicious, verdict, reason) of a labelled reply; without a verdict line it is an error, never clean."""
    word = F.regexp_extract(raw, r"(?iu)KARAR:\s*(ŞÜPHELİ|TEMİZ|ŞÜPHELI)", 1)
    found, suspect = word != "", F.contains(F.upper(word), F.lit("PHE"))
    verdict = F.when(~found, "HATA").when(suspect, "ŞÜPHELİ").otherwise("TEMİZ")
    said = F.regexp_extract(raw, r"(?iu)GEREKÇE:\s*(.+)", 1)
    reason = F.when(said != "", F.btrim(said)).otherwise(F.coalesce(F.nullif(raw, F.lit("")), F.lit("Model geçerli bir karar döndürmedi.")))
    return found & suspect, verdict, reason
