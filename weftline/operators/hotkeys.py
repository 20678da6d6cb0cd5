"""Rules whose outcomes feed back into later decisions, for keys of any size.

The events of an ordinary key are sorted and streamed in one task. A key of more than CHUNK_ROWS events is cut into chunks
in order of time, by ranges of its events' times, that any task can take; what one chunk hands to the next is small:

- cooldown: which event passes first in a chunk depends on the last one that passed before it, and so on those few events
  that lie within one cooldown of the chunk's start. In a chunk, each event points to the next that may pass after it;
  doubling these pointers tells where the chain from each of the few ends, and equal ends next to each other are one. Chunks
  are thus steps of a function from the last passing time to the last passing time, which are composed in order;
- throttle: a chunk hands on the times that still count. Chunks are run side by side from what is known of the state before
  them, and again only if that has changed, until nothing changes. A right code or a quiet minute makes chunks independent.
  Where neither does, a round moves each key on by one chunk: chunks next to each other are therefore joined up to the size
  of one, and a round reads the files of its own chunks alone, so that all rounds together read a key's events about twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from weftline.operators import ranges
from weftline.sources.shared import durable, folder

#: Events beyond which a key is cut into chunks, and about how many of them a chunk has.
CHUNK_ROWS = 200_000

#: (state, microseconds, flag) to (state, outcome); a state is a tuple of times, the first one is empty.
Step = Callable[[tuple, int, bool], tuple[tuple, bool]]


def _lead(key: str):
    return [F.col(key).cast("string").alias("_w_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_w_time"), F.col("flag").alias("_w_flag")]


def _streamed(step: Step, columns: int, names: list[str], states: dict | None = None):
    """Runs the rule over sorted batches of (key, chunk, time, flag, and further columns, which are kept)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, state = None, ()
        for batch in batches:
            found = []
            for k, c, t, flag in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, c) != own:
                    own, state = (k, c), (states or {}).get((k, c), ())
                state, outcome = step(state, t, flag)
                found.append(outcome)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(found, pa.bool_())], names=names)

    return run


def sequential(events: DataFrame, key: str, step: Step, out: str, passing: int | None = None, chunk: int | None = None) -> DataFrame:
    """Adds the boolean `out` by the rule, for events (key, ts, event_id, flag) in order of time and event_id.

    `passing`: the rule is a cooldown of so many microseconds. Nulls are a key like others.
    """
    chunk = chunk or CHUNK_ROWS
    names = [*events.columns, out]
    schema = StructType([*events.schema.fields, StructField(out, BooleanType())])
    sizes = events.groupBy(F.col(key).cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    hot = durable(sizes)
    ordered = lambda rows: rows.repartition("_w_key").sortWithinPartitions("_w_key", "_w_time", "event_id")
    wide = events.select(*_lead(key), *events.columns)
    plain = lambda rows: ordered(rows).select("_w_key", F.lit(0).alias("_w_chunk"), "_w_time", "_w_flag", *events.columns).mapInArrow(_streamed(step, len(names), names), schema)
    if hot.isEmpty():
        return plain(wide)
    # no more keys than there are chunks in all rows
    same, few = F.col("_w_key").eqNullSafe(F.col("_k")), F.broadcast(hot.select("_k"))
    rest = plain(wide.join(few, same, "left_anti"))
    cut = _cut(wide.join(few, same, "left_semi"), hot, chunk)
    cut = cut if passing is not None else _joined(cut, chunk)
    states = _passing_before(cut, passing) if passing is not None else _settled(cut, step)
    apart = cut.repartition("_w_key", "_w_chunk").sortWithinPartitions("_w_key", "_w_chunk", "_w_time", "event_id")
    apart = apart.select("_w_key", "_w_chunk", "_w_time", "_w_flag", *events.columns)
    return rest.unionByName(apart.mapInArrow(_streamed(step, len(names), names, states), schema))


def _cut(hot: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """The hot keys' events with the chunk they are in: ranges of the times of all of them, about `chunk` events each. Stored.

    Events of one instant share a chunk, so that chunks follow one another in time.
    """
    total = sizes.agg(F.sum("_n")).first()[0]
    at = F.col("_w_time")
    cuts = ranges.edges(hot, at, min(ranges.MOST_CELLS, -(-total // chunk) + 1))
    return durable(hot.withColumn("_w_chunk", F.coalesce(ranges.cell(at, cuts), F.lit(-1))))


def _joined(cut: DataFrame, chunk: int) -> DataFrame:
    """`cut` with chunks that follow one another in a key joined, named by the first, while they have no more than `chunk` events together.

    Chunks are cut by the times of all hot keys, so that one key has a part of their events only.
    """
    sizes = cut.groupBy("_w_key", "_w_chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes.sort(key=lambda r: (r["_w_key"] is not None, r["_w_key"] or "", r["_w_chunk"]))
    into, own, first, held = [], None, None, 0
    for key, number, n in sizes:
        if first is None or key != own or held + n > chunk:
            own, first, held = key, number, 0
        held += n
        into.append((key, number, first))
    # a row for each chunk of a hot key
    table = F.broadcast(cut.sparkSession.createDataFrame(into, "_k string, _c int, _first int"))
    same = F.col("_w_key").eqNullSafe(F.col("_k")) & (F.col("_w_chunk") == F.col("_c"))
    return cut.join(table, same).withColumn("_w_chunk", F.col("_first")).drop("_k", "_c", "_first")


def _ends(times: np.ndarray, us: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, ends): an event that passes first in a chunk, at the last of `times` or before, ends the chunk's chain at `ends`."""
    times = np.unique(times)
    n = len(times)
    ahead = np.searchsorted(times, times + us)
    last = np.arange(n)
    while (ahead < n).any():
        go = ahead < n
        # twice as far in each round: where the chain of an event's successor stands, and what lies after that
        last = np.where(go, last[np.minimum(ahead, n - 1)], last)
        ahead = np.where(go, ahead[np.minimum(ahead, n - 1)], n)
    first = min(int(np.searchsorted(times, times[0] + us)), n - 1)
    starts, ends = times[: first + 1], times[last[: first + 1]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return starts[keep], ends[keep]


def _passing_before(cut: DataFrame, us: int) -> dict:
    """(key, chunk): the last passing time before the chunk. What is gathered are steps: a few for each chunk."""
    own = "_w_key string, _w_chunk int, starts array<long>, ends array<long>"

    def summed(key, frame: pd.DataFrame) -> pd.DataFrame:
        starts, ends = _ends(np.sort(frame["_w_time"].to_numpy()), us)
        return pd.DataFrame([(*key, starts.tolist(), ends.tolist())], columns=["_w_key", "_w_chunk", "starts", "ends"])

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for key, chunk, starts, ends in frame.sort_values("_w_chunk").itertuples(index=False):
            out.append((key, chunk, last))
            at = 0 if last is None else int(np.searchsorted(starts, last + us))
            if at < len(starts):
                last = int(ends[at])
        return pd.DataFrame(out, columns=["_w_key", "_w_chunk", "last"]).astype({"last": "Int64"})

    steps = durable(cut.select("_w_key", "_w_chunk", "_w_time").groupBy("_w_key", "_w_chunk").applyInPandas(summed, own))
    found = steps.groupBy("_w_key").applyInPandas(composed, "_w_key string, _w_chunk int, last long")
    # one row for each chunk of a hot key
    return {(r["_w_key"], r["_w_chunk"]): (r["last"],) for r in found.collect() if r["last"] is not None}


def _settled(cut: DataFrame, step: Step) -> dict:
    """(key, chunk): the state before the chunk, by rounds in which chunks run whose state before has changed."""
    spark = cut.sparkSession
    narrow, path = cut.select("_w_key", "_w_chunk", "_w_time", "event_id", "_w_flag"), folder(spark, "chunks")
    narrow.repartition("_w_key", "_w_chunk").write.partitionBy("_w_chunk").parquet(path)
    read = lambda *places: spark.read.schema(narrow.schema).option("basePath", path).parquet(*places)
    chunks = [(r["_w_key"], r["_w_chunk"]) for r in read(path).select("_w_key", "_w_chunk").distinct().collect()]
    chunks.sort(key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    before: dict = dict.fromkeys(chunks, ())
    after: dict = {}
    todo = list(chunks)

    def ended(states):
        def run(batches) -> Iterator[pa.RecordBatch]:
            own, state, found = None, (), []
            for batch in batches:
                for k, c, t, flag in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if (k, c) != own:
                        if own is not None:
                            found.append((*own, list(state)))
                        own, state = (k, c), states[k, c]
                    state, _ = step(state, t, flag)
            if own is not None:
                found.append((*own, list(state)))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_w_key", "_w_chunk", "state"])

        return run

    while todo:
        chosen = F.broadcast(spark.createDataFrame(todo, "_k string, _c int"))
        # no other chunk's files are opened
        files = read(path) if len(todo) == len(chunks) else read(*(f"{path}/_w_chunk={c}" for c in sorted({c for _, c in todo})))
        rows = files.join(chosen, F.col("_w_key").eqNullSafe(F.col("_k")) & (F.col("_w_chunk") == F.col("_c")), "left_semi")
        rows = rows.repartition("_w_key", "_w_chunk").sortWithinPartitions("_w_key", "_w_chunk", "_w_time", "event_id")
        rows = rows.select("_w_key", "_w_chunk", "_w_time", "_w_flag")
        for r in rows.mapInArrow(ended({c: before[c] for c in todo}), "_w_key string, _w_chunk int, state array<long>").collect():
            after[r["_w_key"], r["_w_chunk"]] = tuple(r["state"])
        todo = []
        for one, following in zip(chunks, chunks[1:], strict=False):
            if one[0] == following[0] and before[following] != after[one]:
                before[following] = after[one]
                todo.append(following)
    return before
