"""Messages of monitored sessions by type, each with its schema, as lines of a growing log.

A message is a JSON object with `type`, `ts` and the fields of its type. What is no object, has an unknown type, lacks a
required field or holds a value that does not fit its type is a bad line, with the reason. Every good row keeps (file, position),
which names the line for good: sinks that are keyed by it, or by the batch's number, take nothing twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.lines import LineFiles

_WHO = "token string, student_id string"
_TAB = "tab_url string, tab_title string"
_CONTEXT = "client_context struct<active_process:string,window_title:string,extensions:array<string>>"
#: Type: (further fields, those that must be there). Times are `ts`.
TYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "join": (_WHO, ("token",)),
    "leave": (_WHO, ("token",)),
    "heartbeat": (_WHO, ("token",)),
    "session": (_WHO, ("token",)),
    "verify": ("code string, name string, student_id string, addr string", ("name", "student_id")),
    "pairing_create": ("token string, code string, exam_id string", ("token", "code")),
    "pairing_exchange": ("code string, exam_id string, use_id string", ("code",)),
    "screenshot": (f"{_WHO}, event_id string, reason string, screenshot string, details string, {_TAB}, {_CONTEXT}", ("token", "screenshot")),
    "alert": (f"{_WHO}, event_id string, kind string, reason string, details string, {_TAB}, extensions array<string>, analysis_status string, verdict string, agent_reason string", ("token",)),
    "focus": ("token string, student_id string, focused boolean", ("token", "focused")),
    "start_exam": ("exam_id string, mode string, minutes double, exam_code string, allowed_urls array<string>", ("exam_id",)),
    "stop_exam": ("exam_id string", ()),
    "update_duration": ("exam_id string, minutes double", ("minutes",)),
    "change_mode": ("mode string", ("mode",)),
    "update_urls": ("allowed_urls array<string>", ("allowed_urls",)),
    "update_exam_code": ("exam_code string", ("exam_code",)),
}
#: Longest name, student id and pairing code.
NAME_CHARS, STUDENT_CHARS, CODE_CHARS = 100, 64, 128
_BAD = "_corrupt"


def log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of lines (file, position, value) of a folder of growing files."""
    spark.dataSource.register(LineFiles)
    return spark.readStream.format("weftline_lines").options(path=path, **options).load()


def kind(value: Column) -> Column:
    """The type that a line claims; null if it is no JSON object or says none."""
    return F.try_variant_get(F.try_parse_json(value), "$.type", "string")


def schema(name: str) -> str:
    return f"ts timestamp, {TYPES[name][0]}"


def _parsed(lines: DataFrame, name: str) -> DataFrame:
    """The lines that claim the type, with their fields `m` and the reason why they are bad (null if they are good)."""
    wide = f"{schema(name)}, {_BAD} string"
    m = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = lines.where(kind(F.col("value")) == name).withColumn("m", m)
    lacking = F.array_compact(F.array(*(F.when(F.col(f"m.{c}").isNull(), c) for c in ("ts", *TYPES[name][1]))))
    too_long = F.lit(False)
    if name == "verify":
        too_long = (F.length("m.name") > NAME_CHARS) | (F.length("m.student_id") > STUDENT_CHARS) | (F.btrim("m.name") == "") | (F.btrim("m.student_id") == "")
    if name == "pairing_exchange":
        too_long = (F.length("m.code") > CODE_CHARS) | (F.btrim("m.code") == "")
    reason = (
        F.when(F.col(f"m.{_BAD}").isNotNull(), "type_mismatch")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing_"), F.array_join(lacking, ",")))
        .when(F.coalesce(too_long, F.lit(False)), "bad_length")
    )
    return rows.withColumn("reason", reason)


def of_type(lines: DataFrame, name: str) -> DataFrame:
    """The good messages of one type: file, position, ts and the type's fields."""
    fields = [c.split()[0] for c in _top_level(schema(name))]
    return _parsed(lines, name).where("reason IS NULL").select("file", "position", *(F.col(f"m.{c}") for c in fields))


def _top_level(ddl: str) -> list[str]:
    """The fields of a schema, cut at commas outside brackets."""
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def bad(lines: DataFrame) -> DataFrame:
    """file, position, value, reason of every line that is not a good message. Blank lines are none."""
    t = kind(F.col("value"))
    written = lines.where(F.btrim("value") != "")
    known = F.coalesce(t.isin(*TYPES), F.lit(False))
    object_ = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")), F.lit(False))
    strange = written.where(~known).withColumn("reason", F.when(~object_, "not_an_object").otherwise("unknown_type"))
    parts = [strange.select("file", "position", "value", "reason")]
    parts += [_parsed(written, name).where("reason IS NOT NULL").select("file", "position", "value", "reason") for name in TYPES]
    return reduce(DataFrame.unionByName, parts)


def sort_out(path: str):
    """A function for `writeStream.foreachBatch`: good messages under {path}/{type}/batch=n, bad lines under {path}/bad/batch=n.

    A batch that runs again after a failure writes the same folders over again. Its lines are read once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            found = batch.select(kind(F.col("value")).alias("t")).where(F.col("t").isin(*TYPES)).distinct().collect()
            for name in sorted(r.t for r in found):
                of_type(batch, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            bad(batch).write.mode("overwrite").parquet(f"{path}/bad/batch={number}")
        finally:
            batch.unpersist()

    return sink
