"""Dialogue records from flat turns, and their projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import messages as M
from weftline.functions import text as T

PROFILES = ("FAST", "MEM", "SLOW")
MINIMAL = ("_key", "profile", "topic", "source_question", "system", "messages")


def from_turns(turns: DataFrame) -> DataFrame:
    """conv_id, _key, _qi, profile, system, messages of each conversation.

    A leading system turn becomes the `system` column. One shuffle, on the conversation.
    """
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    every = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    profile = F.element_at(F.array(*map(F.lit, PROFILES)), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    leads = F.col("every")[0]["role"] == "system"
    return listed.select("conv_id", every.alias("every")).select(
        "conv_id",
        F.concat_ws("_", F.col("conv_id").cast("string"), profile).alias("_key"),
        F.col("conv_id").alias("_qi"),
        profile.alias("profile"),
        F.when(leads, F.col("every")[0]["content"]).alias("system"),
        F.when(leads, F.slice("every", 2, F.greatest(F.size("every") - 1, F.lit(0)))).otherwise(F.col("every")).alias("messages"),
    )


def minimal(records: DataFrame) -> DataFrame:
    """The six fields of a merged record; a field that is absent becomes null."""
    have = set(records.columns)
    return records.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in MINIMAL))


def sft_rows(records: DataFrame) -> DataFrame:
    """Records for fine-tuning: the system message leads the messages and is no field of its own."""
    return records.withColumn("messages", M.with_system(F.col("system"), F.col("messages"))).drop("system")


def with_simhash(records: DataFrame, words: str, out: str = "simhash") -> DataFrame:
    """Adds the 64-bit SimHash of the column `words`, a text or an array of words. Each row is worked on alone: nothing is shuffled."""
    whole = isinstance(records.schema[words].dataType, StringType)
    return records.withColumn(out, T.simhash64_text(F.col(words)) if whole else T.simhash64(F.col(words)))
