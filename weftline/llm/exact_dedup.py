"""Exact duplicates by a heavy-hitter split.

A frequent-items sketch (the mergeable Misra-Gries summary behind SQL's `approx_top_k`) nominates
digests that a large share of the rows carries. The nominees are verified by an exact aggregate
whose partial sums collapse each hot group inside the map tasks; their winners, at most
`MAX_HEAVY` rows, are broadcast, so that no row of a hot group is shuffled. All other digests
take an ordinary shuffle of narrow rows (id, digest). Text is read once and never moved.

Edge cases: a null text counts as empty; a null id sorts after every other id; of rows that repeat
both id and text exactly one stays; an empty table gives an empty result. Extra columns are ignored
by `duplicate_report` and kept by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

#: Most digests that the sketch may nominate, and the counters it tracks them with.
MAX_HEAVY = 2000
TRACKED = 16_384
#: A digest is heavy from this share of all rows.
HEAVY_SHARE = 1 / 2000


def normalised(text: str = "text"):
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(common.text_or_empty(text), common.WS, " ")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    table = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return common.stored(table.withColumn("h", F.xxhash64("digest")), "digests")


def _decisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, digest, keep_id, group_size, kept of every row. `row` is the row's place in the scan."""
    table = _digests(docs, id_col, text_col)
    found = table.agg(
        F.expr(f"approx_top_k(h, {MAX_HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    heavy = (
        found.select(F.explode("top").alias("t"), "n")
        .where(F.col("t.count") >= F.greatest(F.lit(2), F.col("n") * F.lit(HEAVY_SHARE)))
        .select(F.col("t.item").alias("h"))
    )
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    winners = (
        table.join(F.broadcast(heavy), "h", "left_semi")
        .groupBy("h", "digest")
        .agg(F.min(first).alias("w"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = common.stored(winners, "winners")
    kept = ["doc_id", "row", "digest", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("w.row") == F.col("row")).alias("kept")]
    hot = table.join(F.broadcast(winners), ["h", "digest"]).select(*kept)
    same = Window.partitionBy("h", "digest")
    rest = (
        table.join(F.broadcast(winners.select("h", "digest")), ["h", "digest"], "left_anti")
        .withColumns({"w": F.min(first).over(same), "group_size": F.count(F.lit(1)).over(same)})
        .select(*kept)
    )
    return hot.unionByName(rest)


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decisions(docs, id_col, text_col).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    `docs` must be a stored table: its rows are identified by their place in the scan, which is
    the same each time the table is read.
    """
    keep = _decisions(docs, id_col, text_col).where("kept").select(F.col("row").alias(common.ROW))
    return docs.withColumn(common.ROW, F.monotonically_increasing_id()).join(keep, common.ROW, "left_semi").drop(common.ROW)
