"""Which profiles each question of the bank has dialogues for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.dialogues import PROFILES

FULL, PARTIAL, NONE = "tam", "kısmi", "üretilmedi"


def coverage(questions: DataFrame, produced: DataFrame) -> DataFrame:
    """Per question (qi and its columns): FAST, MEM, SLOW, missing, status; produced: _key.

    Any produced profile, even an unknown one, makes a question at least partial.
    """
    q, p = T.key_tail(F.col("_key"))
    made = produced.select(q.cast("long").alias("qi"), p.alias("p")).where("qi IS NOT NULL").groupBy("qi").agg(F.collect_set("p").alias("made"))
    joined = questions.join(made, "qi", "left").withColumn("made", F.coalesce("made", F.array().cast("array<string>")))
    known = F.array(*map(F.lit, PROFILES))
    missing = F.array_except(known, F.col("made"))
    status = F.when(F.size(missing) == 0, FULL).when(F.size("made") > 0, PARTIAL).otherwise(NONE)
    return joined.select(*questions.columns, *(F.array_contains("made", p).alias(p) for p in PROFILES), missing.alias("missing"), status.alias("status"))


def dead_letters(lines: DataFrame, n_questions: int, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """What a coverage file's lines (line_no, value) give: a row per task or error.

    Columns: line_no, qi, profile, error, _key. Tasks have a null error; an error's key is made of the
    line, so that a rerun finds it done. Types are read from the JSON itself: absent, wrong and null differ.
    """
    v = F.try_parse_json("value")
    parsed = lines.where(F.btrim("value") != "").withColumn("v", v)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    keys = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.json_object_keys("value"))
    absent = F.filter(F.array(*map(F.lit, ("status", "missing", "qi"))), lambda k: ~F.array_contains(keys, k))
    status = F.try_variant_get("v", "$.status", "string")
    listed = F.try_variant_get("v", "$.missing", "array<string>")
    whole = kind("$.qi") == "BIGINT"
    qi = F.when(whole, F.try_variant_get("v", "$.qi", "long"))
    error = (
        F.when(F.col("v").isNull(), "bad_json")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "not_an_object")
        .when(F.size(absent) > 0, F.concat(F.lit("missing_fields:"), F.array_join(absent, ",")))
        .when(~F.coalesce(status.isin(NONE, PARTIAL), F.lit(False)), "skip")
        .when(~F.coalesce(kind("$.missing").startswith("ARRAY"), F.lit(False)) | (F.coalesce(F.size(listed), F.lit(0)) == 0), "missing_not_a_filled_list")
        .when(~F.coalesce(whole, F.lit(False)), "qi_not_an_integer")
        .when((qi < 0) | (qi >= n_questions), "qi_out_of_range")
    )
    staged = parsed.select("line_no", qi.alias("qi"), listed.alias("listed"), error.alias("error")).where("error IS NULL OR error <> 'skip'")
    bad = staged.where("error IS NOT NULL").select("line_no", "qi", F.lit(None).cast("string").alias("profile"), "error")
    good = staged.where("error IS NULL").select("line_no", "qi", F.explode(F.array_distinct("listed")).alias("profile"))
    known = good.withColumn("error", F.when(~F.coalesce(F.col("profile").isin(*profiles), F.lit(False)), "unknown_profile"))
    letter = F.concat(
        F.lit("__invalid__line"), F.col("line_no").cast("string"), F.lit("__qi"), F.coalesce(F.col("qi").cast("string"), F.lit("NA")),
        F.lit("__profile"), F.coalesce(F.nullif("profile", F.lit("")), F.lit("NA")),
    )
    return bad.unionByName(known).withColumn("_key", F.when(F.col("error").isNull(), F.concat_ws("_", F.col("qi").cast("string"), "profile")).otherwise(letter))


def task_order(tasks: DataFrame) -> DataFrame:
    """Adds `place`, by which tasks (status, line_no) are taken up: questions never produced first, then partial ones, each by line."""
    return tasks.withColumn("place", F.struct((F.col("status") != NONE).cast("int").alias("late"), F.col("line_no").cast("long").alias("line_no")))


def with_questions(tasks: DataFrame, bank: DataFrame) -> DataFrame:
    """Tasks and errors (qi, error) with the columns of the question at place qi of the bank; errors get none."""
    names = [c for c in bank.columns if c != "qi"]
    found = tasks.where("error IS NULL").join(bank, "qi", "left").select(*tasks.columns, *names)
    return found.unionByName(tasks.where("error IS NOT NULL"), allowMissingColumns=True)
