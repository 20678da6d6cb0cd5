"""Connected components of a link table by alternating large and small stars.

Each round is a few aggregations and joins of the link table, kept in shared storage; the number of
rounds grows with the logarithm of the longest chain. No neighbourhood is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) after one star operation."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    # a hub's links are met by its broadcast row, not in one task
    least = common.stored(least, "stars")
    joined = common.join_split(both, least, ["u"], "n").drop("n")
    if large:
        found = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots: root is the least node connected with it."""
    links = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        links = common.stored(_stars(_stars(links, True), False), "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
