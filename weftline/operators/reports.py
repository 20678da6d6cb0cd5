"""Summaries of cleaning, splitting and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T


def cleanup_summary(records: DataFrame) -> DataFrame:
    """One row: records, distinct keys (null is one), distinct questions and dialogues per question (4 decimals)."""
    q, _ = T.key_parts(F.col("_key"))
    return records.withColumn("_q", q).agg(
        F.count(F.lit(1)).alias("records"),
        (F.count_distinct("_key") + F.max(F.col("_key").isNull().cast("int"))).alias("unique_keys"),
        F.count_distinct("_q").alias("questions"),
        F.coalesce(F.round(F.count("_q") / F.nullif(F.count_distinct("_q"), F.lit(0)), 4), F.lit(0.0)).alias("dialogues_per_question"),
    )


def profile_counts(records: DataFrame) -> DataFrame:
    """profile (as the key's end says) and n."""
    _, p = T.key_parts(F.col("_key"))
    return records.select(p.alias("profile")).where("profile IS NOT NULL").groupBy("profile").agg(F.count(F.lit(1)).alias("n"))


def split_summary(rows: DataFrame) -> DataFrame:
    """Counts of (profile, sample_type) with all subtotals, and the percentage of errors in each; null: all."""
    return rows.cube("profile", "sample_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("sample_type") == "error") * 100.0 / F.count(F.lit(1)), 4).alias("error_percent")
    )


def merge_summary(outcomes: DataFrame, renamed: Column) -> DataFrame:
    """Per source: rows read, merged, duplicate, missing and renamed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("src_idx").agg(
        F.count(F.lit(1)).alias("read"), n("merged").alias("merged"), n("duplicate").alias("duplicate"), n("missing").alias("missing"), F.count_if(renamed).alias("renamed")
    )


def length_statistics(rows: DataFrame, length: str, limit: int) -> DataFrame:
    """One row: n, least, most, mean, linear 95th percentile, and how many (and what percentage) exceed the limit."""
    over = F.count_if(F.col(length) > limit)
    return rows.agg(
        F.count(length).alias("n"), F.min(length).alias("least"), F.max(length).alias("most"), F.round(F.avg(length), 6).alias("mean"),
        F.round(F.percentile(length, 0.95), 6).alias("p95"), over.alias("over"), F.round(over * 100.0 / F.count(length), 6).alias("over_percent"),
    )


def reconcile(read: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row: rows read, rows in all parts together, and whether they are the same number."""
    total = read.agg(F.count(F.lit(1)).alias("read"))
    written = parts[0].select(F.lit(1).alias("x"))
    for part in parts[1:]:
        written = written.unionByName(part.select(F.lit(1).alias("x")))
    return total.crossJoin(written.agg(F.count(F.lit(1)).alias("written"))).withColumn("balanced", F.col("read") == F.col("written"))


def turkish_witness(rows: DataFrame, text: str, order: str, most: int = 120) -> DataFrame:
    """One row: whether any text has a Turkish letter, and the beginning of the first such text."""
    hit = T.is_turkish(F.col(text))
    return rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"), F.min_by(F.when(hit, F.substring(text, 1, most)), F.when(hit, F.col(order))).alias("example"))
