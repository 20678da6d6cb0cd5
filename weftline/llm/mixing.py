"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. A source that needs the fraction f of its words (after
whole repeats) takes the documents whose hash lies below a threshold: the histogram gives the
bucket in which the budget ends, and only that bucket is refined, `LEVELS` times by `BITS` bits.
Documents are then filtered by comparing their hash with their source's threshold. No document is
sorted, budgets nest (a larger one takes a superset), and reruns agree.

The hash is of source, id and text. Rows that repeat all three are told apart by their number among
themselves, so that a large group of equal rows is taken row by row like any other rows. Numbering goes
by cells of the rows' places, so that no group meets in one task.

Edge cases: a null text has size 0; the null source is a source of its own, last in order; null and
repeated ids are ids like others; a source without words gets target 0; an empty table gives an empty
result. Repeated rows are known by their place in the scan, and the table is read twice: `docs` must be a
stored table, or read alike each time. `mix` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS = 12
LEVELS = 4
#: Cells in which equal rows are numbered side by side.
CELLS = 1024


def _digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def row_key() -> Column:
    """60 bits that rows of one source, id and text share."""
    word = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return _digits(F.concat_ws("/", word("source"), word("doc_id"), F.coalesce(F.md5("text"), F.lit(""))), 15)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the row's key k and its place in the scan."""
    size = F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_key().alias("k"), F.monotonically_increasing_id().alias("row"))


def repeated_hashes(sizes: DataFrame) -> DataFrame:
    """row, k, h of the rows that repeat another row, stored. h: their own hash of BITS * LEVELS bits."""
    again = common.stored(sizes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("_k")), "mix-repeated")
    rows = common.join_small(sizes.select("row", "k"), again, F.col("k") == F.col("_k"), "left_semi")
    rows = rows.withColumn("cell", F.pmod("row", F.lit(CELLS)).cast("int"))
    own = _digits(F.concat_ws("/", F.col("k").cast("string"), F.col("rank").cast("string")), BITS * LEVELS // 4)
    numbered = common.numbered(rows, ["k"], ["cell"], [F.col("row")], "rank")
    return common.stored(numbered.select("row", "k", F.when(F.col("rank") == 0, _first_hash()).otherwise(own).alias("h")), "mix-hashes")


def _first_hash() -> Column:
    return F.shiftright("k", 60 - BITS * LEVELS)


def with_hashes(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds h to rows that have `row` and `k`."""
    theirs = repeated.select(F.col("row").alias("_row"), F.col("h").alias("_h"))
    joined = common.join_small(rows, theirs, F.col("row") == F.col("_row"), "left")
    return joined.withColumn("h", F.coalesce("_h", _first_hash())).drop("_row", "_h")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size and target. The weighted shares sum to all words; capped excess is reshared.

    The shares are min(most * size, level * weight) for one common level. With the sources sorted by
    the level that caps them, capping the first k gives a level for each k that is never too high;
    the true one is the highest of them. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1))
    per = per.withColumns({"cap": F.col("source_size") * most, "capped_at": F.col("source_size") * most / F.col("weight")})
    every, order = Window.partitionBy(), Window.orderBy("capped_at", F.col("source").asc_nulls_last())
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "caps_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_from")
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """Per source: whole repeats, and the hash below which a document is taken once more.

    Each depth sums words by the next BITS bits of the hash, within each source's boundary bucket
    only, and descends into the first bucket in which the budget ends.
    """
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0)
    state = per_source.withColumn("repeats", repeats.cast("long")).withColumns(
        {
            "need": F.col("target") - F.col("repeats") * F.col("source_size"),
            "prefix": F.lit(0).cast("long"),
            "open": F.lit(True),
            "threshold": F.lit(None).cast("long"),
        }
    )
    state = common.stored(state, "mix-state")
    for depth in range(LEVELS):
        shift = BITS * (LEVELS - depth - 1)
        boundary = state.where("open").select(F.col("source").alias("s"), "prefix", "need")
        here = F.col("source").eqNullSafe(F.col("s"))
        if depth:
            inside = common.join_small(sizes, boundary.drop("need"), here & (F.shiftright("h", shift + BITS) == F.col("prefix")), "inner")
        else:
            inside = sizes
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
        ends = (
            sums.join(boundary.drop("prefix"), here)
            .where(F.col("upto") > F.col("need"))
            .groupBy("s")
            .agg(F.min(F.struct("b", "upto", "words")).alias("f"))
        )
        before, found = F.col("f.upto") - F.col("f.words"), F.col("f").isNotNull()
        if depth < LEVELS - 1:
            threshold = F.lit(None).cast("long")
        else:  # the last bucket is one hash value: it is taken if that comes nearer to the budget
            threshold = F.col("f.b") + F.when(before + F.col("f.words") / 2 <= F.col("need"), 1).otherwise(0)
        past = F.shiftleft(F.col("prefix") + 1, shift + BITS)
        state = (
            state.join(ends, here, "left")
            .withColumns(
                {
                    "threshold": F.when(F.col("open"), F.when(found, threshold).otherwise(past)).otherwise(F.col("threshold")),
                    "need": F.when(found, F.col("need") - before).otherwise(F.col("need")),
                    "prefix": F.when(found, F.col("f.b")).otherwise(F.col("prefix")),
                    "open": found,
                }
            )
            .drop("s", "f")
        )
        state = common.stored(state, "mix-state")
    return state.select("source", "source_size", "target", "repeats", "threshold")


def _chosen(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes with hashes, hashes of repeated rows, what each source takes)."""
    sizes = common.stored(sized(docs), "mix-sizes")
    repeated = repeated_hashes(sizes)
    if not repeated.isEmpty():
        sizes = common.stored(with_hashes(sizes, repeated).drop("k", "row"), "mix-sizes")
    else:
        sizes = sizes.withColumn("h", _first_hash()).drop("k", "row")
    return sizes, repeated, thresholds(sizes, targets(sizes)).withColumnRenamed("source", "s")


def _copies():
    return F.col("repeats") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes, _, limits = _chosen(docs)
    joined = common.join_small(sizes, limits, F.col("source").eqNullSafe(F.col("s")), "inner")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as the mix takes it (0 to MAX_REPEATS times)."""
    _, repeated, limits = _chosen(docs)
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").alias("_source"), row_key().alias("k"), F.monotonically_increasing_id().alias("row"))
    joined = common.join_small(with_hashes(rows, repeated), limits, F.col("_source").eqNullSafe(F.col("s")), "inner")
    copies = F.least(_copies(), F.lit(MAX_REPEATS)).cast("int")
    return joined.where(copies > 0).select("doc", F.explode(F.array_repeat(F.lit(0), copies))).select("doc.*")
