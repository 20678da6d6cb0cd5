"""Deterministic stratified and leakage-free splits.

Rows are chosen by a seeded hash of their key, so that reruns agree; the number chosen in each stratum is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.quota import ranked_upto, seeded_order


def _split(rows: DataFrame, strata: list[str], n_val, key: str, seed: int) -> DataFrame:
    """Adds `split`: val for n_val(n) rows of each stratum of n rows, else train."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).select(*strata, n_val(F.col("_n")).alias("_val"))
    ordered = rows.join(sizes, strata).withColumn("_ord", seeded_order(F.col(key), seed))
    chosen = ranked_upto(ordered, strata, "_ord", "_val", "_in")
    return chosen.withColumn("split", F.when(F.col("_in"), "val").otherwise("train")).drop("_in", "_val", "_ord")


def by_profile(rows: DataFrame, ratio: float = 0.10, key: str = "_key", seed: int = 42) -> DataFrame:
    """Validation rows: the ratio rounded half to even, at least one; fewer than all unless there is one row only."""

    def n_val(n: Column) -> Column:
        wanted = F.greatest(F.bround(n * F.lit(ratio), 0).cast("long"), F.lit(1))
        return F.when(n > 1, F.least(wanted, n - 1)).otherwise(wanted)

    return _split(rows, ["profile"], n_val, key, seed)


def by_profile_and_type(rows: DataFrame, ratio: float = 0.10, key: str = "_key", seed: int = 42) -> DataFrame:
    """Validation rows of each (profile, sample_type): the ratio rounded down."""
    return _split(rows, ["profile", "sample_type"], lambda n: F.floor(n * F.lit(ratio)), key, seed)


def by_label(rows: DataFrame, label: str, ratio: float = 0.15, key: str = "_key", seed: int = 42) -> DataFrame:
    """A stratified split of ceil(ratio * n) rows in all, dealt to labels by largest remainders (ties by label)."""
    from pyspark.sql import Window

    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    shared = sizes.withColumn("total", F.ceil(F.sum("n").over(every) * F.lit(ratio))).withColumn("exact", F.col("n") * F.col("total") / F.sum("n").over(every))
    floors = shared.withColumn("base", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("base") - F.col("exact"), 9), label))
    quota = floors.withColumn("_val", F.col("base") + (rank <= F.col("total") - F.sum("base").over(every)).cast("int")).select(label, "_val")
    ordered = rows.join(quota, label).withColumn("_ord", seeded_order(F.col(key), seed))
    chosen = ranked_upto(ordered, [label], "_ord", "_val", "_in")
    return chosen.withColumn("split", F.when(F.col("_in"), "val").otherwise("train")).drop("_in", "_val", "_ord")


def by_question(rows: DataFrame, val_ratio: float = 0.10, test_ratio: float = 0.10, seed: int = 42) -> DataFrame:
    """Adds `split` (train, val, test) to rows of (question, profile, _key); no question is in two splits.

    Questions are stratified by the profiles that they have and whether any of their keys is renamed.
    Both parts are rounded half to even; where they would leave nothing to train on, and there are
    three questions or more, validation gives way first.
    """
    bucket = F.concat(F.array_join(F.array_sort(F.collect_set(F.btrim("profile"))), ""), F.lit("|error="), F.max(F.startswith("_key", F.lit("_")).cast("int")).cast("string"))
    questions = rows.groupBy("question").agg(bucket.alias("bucket"))
    sizes = questions.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    t, v, n = F.bround(F.col("n") * F.lit(test_ratio), 0).cast("long"), F.bround(F.col("n") * F.lit(val_ratio), 0).cast("long"), F.col("n")
    tight = (t + v >= n) & (n >= 3)
    v2 = F.when(tight, F.greatest(F.lit(0), F.least(v, n - 1 - t))).otherwise(v)
    t2 = F.when(tight, F.least(t, n - 1 - v2)).otherwise(t)
    quota = sizes.select("bucket", t2.alias("_t"), (t2 + v2).alias("_tv"))
    ordered = questions.join(quota, "bucket").withColumn("_ord", seeded_order(F.col("question").cast("string"), seed))
    placed = ranked_upto(ranked_upto(ordered, ["bucket"], "_ord", "_t", "_test"), ["bucket"], "_ord", "_tv", "_held")
    named = placed.select("question", "bucket", F.when(F.col("_test"), "test").when(F.col("_held"), "val").otherwise("train").alias("split"))
    return rows.join(named, "question")


def overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split: none in a sound one."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
