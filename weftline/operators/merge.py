"""Merging judged keys with their dialogues."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weftline.operators import ranges
from weftline.operators.quota import ranked


def _one_per_key(dialogues: DataFrame, order: Column) -> DataFrame:
    """One dialogue a key. Ordering columns travel in one aggregate, so hot keys combine early."""
    rest = [c for c in dialogues.columns if c != "_key"]
    picked = dialogues.groupBy("_key").agg(F.min_by(F.struct(*rest), order).alias("d"))
    return picked.select("_key", "d.*")


def _keyed(passed: DataFrame, dialogues: DataFrame) -> DataFrame:
    """One row for each passed key: how many rows it has, the first of them, and its dialogue, if there is one."""
    groups = passed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("src_idx", "line_no")).alias("_first"))
    return groups.join(dialogues, "_key", "left")


def first_wins(passed: DataFrame, dialogues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, missing): passed rows (_key, src_idx, line_no) with the first dialogue of their key. Rows of heavy keys stay where they are."""
    unique = _one_per_key(dialogues.withColumnRenamed("line_no", "dialogue_line"), F.col("dialogue_line"))
    joined = ranges.join_split(passed, _keyed(passed, unique.withColumn("_found", F.lit(True))), ["_key"], "_n").drop("_n", "_first")
    merged = joined.where("_found").drop("_found").select("_key", *(c for c in joined.columns if c not in ("_key", "_found")))
    return merged, joined.where("_found IS NULL").select(*passed.columns)


def last_wins(passed: DataFrame, dialogues: DataFrame) -> DataFrame:
    """Passed rows with the last dialogue of their key and an `outcome`: merged, duplicate or missing.

    Missing is found first; of the matched rows of one key, the first by source and line is merged. Each key's first row is found
    by an aggregate, and heavy keys' rows stay where they are.
    """
    unique = _one_per_key(dialogues.withColumnRenamed("line_no", "dialogue_line"), -F.col("dialogue_line"))
    joined = ranges.join_split(passed, _keyed(passed, unique), ["_key"], "_n")
    found, first = F.col("dialogue_line").isNotNull(), F.struct("src_idx", "line_no") == F.col("_first")
    return joined.withColumn("outcome", F.when(~found, "missing").when(first, "merged").otherwise("duplicate")).drop("_n", "_first")


def renamed(rows: DataFrame) -> DataFrame:
    """Gives each row of (_key, src_idx, line_no) a key of its own, `new_key`, by underscores put in front.

    Rows come in order of source and line; a key that is taken gets one more underscore until it is
    free. Only keys that are alike but for leading underscores can collide. Where all keys of a base have
    the same underscores, the n-th row simply gets n - 1 more: places are counted by ranges of lines, so
    that no base meets in one task. Otherwise a row of u underscores takes the least free count from u on;
    such bases are streamed in order, and a task holds one number for each u of its base.
    """
    base, own = F.regexp_replace("_key", "^_+", ""), F.length("_key") - F.length(F.regexp_replace("_key", "^_+", ""))
    keyed = rows.select("*", base.alias("_base"), own.cast("int").alias("_own"))
    kinds = keyed.groupBy("_base").agg((F.min("_own") == F.max("_own")).alias("_plain"))
    marked = keyed.join(kinds, "_base")
    simple = ranked(marked.where("_plain"), ["_base", "src_idx"], "line_no", "_rank")
    sizes = marked.where("_plain").groupBy("_base", "src_idx").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_base").orderBy("src_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    simple = simple.join(sizes.select("_base", "src_idx", earlier.alias("_earlier")), ["_base", "src_idx"])
    simple = simple.withColumn("_at", (F.col("_own") + F.col("_earlier") + F.col("_rank") - 1).cast("int"))

    names = [*rows.columns, "_base", "_at"]

    def assign(batches):
        current, free = None, {}
        for batch in batches:
            out = []
            for name, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != current:
                    current, free = name, {}
                at = free.get(u, u)  # all from v up to free[v] are taken, for every v
                while (past := max((end for v, end in free.items() if v <= at < end), default=at)) > at:
                    at = past
                free[u] = at + 1
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(out, pa.int32())], names=names)

    hard = marked.where("NOT _plain").select("_base", "_own", *rows.columns).repartition("_base").sortWithinPartitions("_base", "src_idx", "line_no")
    placed = hard.mapInArrow(assign, StructType([*rows.schema.fields, StructField("_base", StringType()), StructField("_at", IntegerType())]))
    both = simple.select(*rows.columns, "_base", "_at").unionByName(placed)
    return both.withColumn("new_key", F.concat(F.repeat(F.lit("_"), F.col("_at")), "_base")).drop("_base", "_at")


def sample_type(keys: DataFrame, run_keys: DataFrame, normal_keys: DataFrame) -> DataFrame:
    """Adds `sample_type`: error for keys with a leading underscore or from the first run only, else normal."""
    run = run_keys.select("_key").distinct().withColumn("_run", F.lit(True))
    normal = normal_keys.select("_key").distinct().withColumn("_normal", F.lit(True))
    error = F.startswith("_key", F.lit("_")) | (F.col("_run").isNotNull() & F.col("_normal").isNull())
    return keys.join(run, "_key", "left").join(normal, "_key", "left").withColumn("sample_type", F.when(error, "error").otherwise("normal")).drop("_run", "_normal")
