"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of `N_SLOTS` virtual slots. Bytes and rows are aggregated per slot; a
slot-to-shard map, bounded by the number of slots and not by the data, decides the shard. Version 0
deals slots round robin. Rebalancing edits the map: it moves single slots from the fullest to the
emptiest shard until sizes are near equal, and stores the edited map as the next version. Adding a
shard is the same edit with one more, empty, shard.

A slot that holds `LARGE` times an average slot, in bytes or rows (one key with very many rows), is cut
by the rows' place in the scan into fragments of about half that size; each fragment is placed like a
slot of its own. Slots and fragments together are fewer than 2 * N_SLOTS, whatever the data.

Edge cases: a null text has no bytes (a row still counts `ROW_BYTES`) and the checksum of the empty
string; null and repeated ids hash like any value; repeated rows are placed one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

N_SLOTS = 8192
#: A slot is cut from so many times the average slot.
LARGE = 4
ROW_BYTES = 16
#: Rebalancing stops when the fullest shard exceeds the emptiest by this share of the mean.
TOLERANCE = 0.001

MAP_SCHEMA = "version int, slot int, fragment int, shard int, bytes long, rows long"


def assign_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, row (place in the scan) and virtual_slot."""
    text = common.text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def large_slots(assigned: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, fan: into how many fragments each oversized slot is cut. Stored; at most n_slots / 2 rows."""
    slots = assigned.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = slots.agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))
    times = F.greatest(F.col("bytes") * n_slots / F.col("all_bytes"), F.col("rows") * n_slots / F.col("all_rows"))
    fan = F.least(F.ceil(times * 2 / LARGE), F.col("rows")).cast("int")
    cut = slots.join(F.broadcast(totals)).where((times >= LARGE) & (F.col("rows") > 1))
    return common.stored(cut.select("virtual_slot", fan.alias("fan")), "large-slots")


def with_fragments(assigned: DataFrame, large: DataFrame) -> DataFrame:
    """Adds `fragment`: -1 in whole slots, a number below `fan` in slots that are cut."""
    fragment = F.when(F.col("fan").isNotNull(), F.pmod("row", F.col("fan"))).otherwise(-1).cast("int")
    return assigned.join(F.broadcast(large), "virtual_slot", "left").withColumn("fragment", fragment).drop("fan")


def slot_statistics(fragmented: DataFrame) -> DataFrame:
    """slot, fragment, bytes, rows. Fragment -1 stands for a whole slot."""
    cells = fragmented.groupBy(F.col("virtual_slot").alias("slot"), "fragment")
    return cells.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def initial_map(statistics: DataFrame, n_shards: int) -> DataFrame:
    """Version 0: slots dealt round robin, whatever they hold."""
    place = F.pmod(F.col("slot") + F.greatest("fragment", F.lit(0)), F.lit(n_shards)).cast("int")
    return statistics.select(F.lit(0).alias("version"), "slot", "fragment", place.alias("shard"), "bytes", "rows")


def rebalanced(current: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of a map: single slots moved from the fullest to the emptiest shard.

    The map has a row per slot (or fragment of an oversized slot): fewer than 2 * N_SLOTS rows
    whatever the data, so editing it is the driver's work.
    """
    rows = [r.asDict() for r in current.orderBy("slot", "fragment").collect()]
    load = {s: 0 for s in range(n_shards)}
    held = defaultdict(list)
    for i, r in enumerate(rows):
        load[r["shard"]] += r["bytes"]
        held[r["shard"]].append(i)
    mean = sum(load.values()) / n_shards
    low = [(v, s) for s, v in load.items()]
    high = [(-v, s) for s, v in load.items()]
    heapq.heapify(low)
    heapq.heapify(high)
    stuck: set[int] = set()
    for _ in range(20 * max(1, len(rows))):
        while load[low[0][1]] != low[0][0]:
            heapq.heappop(low)
        while high and (high[0][1] in stuck or load[high[0][1]] != -high[0][0]):
            heapq.heappop(high)
        if not high:
            break
        (least, to), (most, frm) = low[0], high[0]
        gap = -most - least
        if gap <= tolerance * mean:
            break
        movable = [i for i in held[frm] if 0 < rows[i]["bytes"] < gap]
        if not movable:  # one slot fills this shard: the next fullest may still give
            heapq.heappop(high)
            stuck.add(frm)
            continue
        i = min(movable, key=lambda j: abs(rows[j]["bytes"] - gap / 2))
        held[frm].remove(i)
        held[to].append(i)
        rows[i]["shard"] = to
        for s, change in ((frm, -rows[i]["bytes"]), (to, rows[i]["bytes"])):
            load[s] += change
            heapq.heappush(low, (load[s], s))
            heapq.heappush(high, (-load[s], s))
    for r in rows:
        r["version"] += 1
    return current.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in MAP_SCHEMA.split(", ")) for r in rows], MAP_SCHEMA)


class SlotMap:
    """The stored versions of a slot-to-shard map."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{common.shared_dir(spark).rstrip('/')}/weftline/slot-map-{uuid.uuid4().hex}"

    def save(self, entries: DataFrame) -> None:
        entries.coalesce(1).write.mode("append").partitionBy("version").parquet(self.path)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path).where(F.col("version") == version)


def shard_documents(docs: DataFrame, n_shards: int, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot of every document.

    Law `bytes`: the shards' sizes are near equal. `slot` is the row's gapless place in its shard.
    """
    spark = docs.sparkSession
    assigned = common.stored(assign_slots(docs), "slots")
    fragmented = with_fragments(assigned, large_slots(assigned))
    versions = SlotMap(spark, path)
    versions.save(initial_map(slot_statistics(fragmented), n_shards))
    versions.save(rebalanced(versions.load(0), n_shards))
    current = versions.load(1).select(F.col("slot").alias("virtual_slot"), "fragment", "shard")
    # fewer than 2 * N_SLOTS narrow rows: bounded by a parameter
    placed = fragmented.join(F.broadcast(current), ["virtual_slot", "fragment"])
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("row")]
    return common.numbered(placed, ["shard"], ["virtual_slot", "fragment"], order, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
