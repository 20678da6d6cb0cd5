"""Repair of conversation structure by a cost-to-go table and a greedy walk.

The roles of a conversation should read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in
turn. A row is kept, given another role, or deleted, and empty turns are inserted; the cheapest edits are found by a
dynamic programme over turn and grammar state, run backwards. A walk from the start then takes, among the steps that
keep the least cost, the one whose initial comes first in ASCII, which gives the least of the cheapest edit strings;
the repaired turns are built along it.

Conversations of up to LARGE_ROWS rows and LARGE_BYTES bytes are sorted and walked whole, one at a time, in streams. Larger
ones are cut into chunks of CHUNK rows that any task can take: a chunk is first reduced to a 4 x 4 matrix of least
costs between grammar states; folding these backwards gives the costs to go at every chunk's end, with which each chunk is
walked from each of the four states; folding the walks forwards selects one for each chunk. Only these summaries of chunks,
and for the digest the repaired bytes in pieces, pass through one place for a conversation: its own audit string has a
character for every row anyway, and its digest is that of one stream of bytes. Both ways give the same rows (tested).

Edge cases: damage reads nulls as one space, in ids, turns, roles and texts; the null conv_id is one conversation. Turns are
ordered with nulls first; rows of one turn by role, then by text. Rows repeated in the input are rows like others (duplicates of the first).
Roles are told apart by their first character as it is; one that is empty, or no s, u or a, fits nowhere. Empty texts are blank;
very long texts are streamed in large conversations. `gaps` is exact up to the largest long. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: Conversations of more rows or bytes are cut into chunks.
LARGE_ROWS = 4096
LARGE_BYTES = 32 << 20
CHUNK = 4096
#: Bytes of repaired text that travel as one piece.
PIECE = 1 << 20

#: Grammar states: nothing yet, after s, after u, after a. What each initial leads to, and what a new turn would be.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_MANY = 1 << 60
_END = (0, _MANY, _MANY, 0)
OK, BLANK, DUPLICATE, CUT = range(4)


def _kind(conv: Column, turn: Column) -> Column:
    word = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of id and turn chooses; nulls become one space, but in ids and turns."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = _kind(F.col(conv), F.col(turn))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, "user").otherwise(word("role"))
    found = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return found.withColumn("_copy", twice).drop("kind", "_copy")


def _fault(text: Column) -> Column:
    """The fault that a row has by itself: blank, cut off or none."""
    last = F.right(F.regexp_replace(text, r"[\x20\x09-\x0D]+$", ""), F.lit(1))
    return F.when(~text.rlike(common.WORD), BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)


def _step(initial: str, fault: int, state: int, here: tuple, after: tuple) -> tuple[str, int]:
    """The first edit in ASCII order that keeps the least cost `here[state]`, and the state it leads to."""
    least = here[state]
    if after[state] + DELETE == least:
        return "D", state
    if here[_NEXT[state]] + INSERT == least:
        return "I", _NEXT[state]
    more = TRUNCATED if fault == CUT else 0
    kept = _AFTER.get(initial, {}).get(state)
    if kept is not None and after[kept] + more == least:
        return "K", kept
    return "R", _NEXT[state]


def _before(initial: str, fault: int, after: tuple) -> tuple:
    """Costs to go before a row, from those after it."""
    costs = [c + DELETE for c in after]
    if fault in (OK, CUT):
        more = TRUNCATED if fault == CUT else 0
        leads = _AFTER.get(initial, {})
        for state in range(4):
            costs[state] = min(costs[state], after[_NEXT[state]] + RENAME + more)
            if state in leads:
                costs[state] = min(costs[state], after[leads[state]] + more)
    return _inserted(costs)


def _inserted(costs: list) -> tuple:
    """The costs if turns may be inserted first; two in a row lead from everywhere to every state that they can lead to."""
    for _ in range(2):
        costs = [min(c, costs[_NEXT[state]] + INSERT) for state, c in enumerate(costs)]
    return tuple(costs)


def _table(initials: list, faults: list, end: tuple) -> list[tuple]:
    """Costs to go before each row and, last, after all of them."""
    table = [end]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        table.append(_before(initial, fault, table[-1]))
    return table[::-1]


def walk(initials: list, faults: list, table: list[tuple], state: int, last: bool) -> tuple[str, list[list[str]], int]:
    """(edits, for each row and for the end the edits there, the state reached). Turns are inserted after the rows only if these are the `last` ones."""
    groups = []
    for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        here = []
        while True:
            edit, state = _step(initial, fault, state, table[i], table[i + 1])
            here.append(edit)
            if edit != "I":
                break
        groups.append(here)
    rest = []
    while last and _END[state]:
        rest.append("I")
        state = _NEXT[state]
    groups.append(rest)
    return "".join(map("".join, groups)), groups, state


def _repaired(groups: list[list[str]], rows, state: int) -> Iterator[str]:
    """The repaired turns; rows: (role, text) of each."""
    rows = iter(rows)
    for here in groups:
        role, text = next(rows, ("", ""))
        for edit in here:
            if edit == "I":
                yield _ROLE[state] + ":"
                state = _NEXT[state]
            elif edit == "K":
                yield f"{role}:{text}"
                state = _AFTER[role[0]][state]
            elif edit == "R":
                yield f"{_ROLE[state]}:{text}"
                state = _NEXT[state]


def _illegal(initials: list) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))


def repair(turns: list[tuple[str, str, int]]) -> tuple[int, int, int, int, int, str, str]:
    """blank, duplicate, truncated, illegal, cost, audit, digest of one conversation's ordered rows (role, text, own fault)."""
    seen, initials, faults = set(), [], []
    for role, text, fault in turns:
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        initials.append(role[:1])
        faults.append(fault)
    table = _table(initials, faults, _inserted(list(_END)))
    audit, groups, _ = walk(initials, faults, table, 0, True)
    digest = sha256("\n".join(_repaired(groups, ((r, t) for r, t, _ in turns), 0)).encode()).hexdigest()
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), _illegal(initials), table[0][0], audit, digest


_COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _order() -> tuple[Column, ...]:
    return F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()


def _small(rows: DataFrame, kind: str) -> DataFrame:
    """conv_id and what `repair` says, for conversations that a task holds one at a time."""
    names = ["conv_id", *(c.split()[0] for c in _COUNTS.split(", "))]

    def run(batches):
        held, own, ids, found = [], None, [], []
        for batch in batches:
            keys = batch.column(0)
            columns = (batch.column(c).to_pylist() for c in ("role", "text", "fault"))
            for i, (key, role, text, fault) in enumerate(zip(keys.to_pylist(), *columns, strict=True)):
                if not held or key != own:
                    if held:
                        found.append(repair(held))
                    held, own = [], key
                    ids.append(keys.slice(i, 1))
                held.append((role, text, fault))
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids[: len(found)]), *map(pa.array, zip(*found, strict=True))], names=names)
                ids, found = ids[len(found) :], []
        if held:
            yield pa.RecordBatch.from_arrays([ids[0], *(pa.array([v]) for v in repair(held))], names=names)

    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *_order())
    return ordered.select("conv_id", "role", "text", "fault").mapInArrow(run, f"conv_id {kind}, {_COUNTS}")


def _with_duplicates(turns: DataFrame) -> DataFrame:
    """c, at, chunk, initial, fault of the rows, with the fault `duplicate` where role and text came before. Stored."""
    narrow = turns.select("c", "at", "chunk", F.left("role", F.lit(1)).alias("initial"), "fault", "digest")
    full = narrow.where(F.col("fault") != BLANK)
    again = full.groupBy("c", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.stored(again, "turns-again")
    later = common.join_split(full, again, ["c", "digest"], "n").where("at > first").select("at", F.lit(True).alias("again"))
    fault = F.when(F.col("again"), DUPLICATE).otherwise(F.col("fault"))
    return common.stored(narrow.join(later, "at", "left").select("c", "at", "chunk", "initial", fault.alias("fault")), "turns-marked")


def _summaries(marked: DataFrame) -> DataFrame:
    """Of each chunk of a conversation: the matrix of least costs between states, faults, and its ends. Stored."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        initials, faults = frame["initial"].tolist(), frame["fault"].tolist()
        # turns that are inserted after these rows belong to what follows
        columns = [_table(initials, faults, tuple(0 if t == goal else _MANY for t in range(4)))[0] for goal in range(4)]
        matrix = [min(columns[t][s], _MANY) for s in range(4) for t in range(4)]
        row = (*key, matrix, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), _illegal(initials), initials[0], initials[-1])
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    schema = "c string, chunk long, matrix array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    return common.stored(marked.groupBy("c", "chunk").applyInPandas(run, schema), "turns-chunks")


def _costs_to_go(chunks: DataFrame) -> DataFrame:
    """c, chunk, last, togo, cost: costs to go after each chunk, and before it from the first state. A conversation's chunks, a few numbers each, are folded in one place. Stored."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ascending=False)
        togo, out = np.array(_inserted(list(_END))), []
        for i, (c, chunk, matrix) in enumerate(zip(frame["c"], frame["chunk"], frame["matrix"], strict=True)):
            before = np.minimum((np.array(matrix).reshape(4, 4) + togo).min(axis=1), _MANY)
            out.append((c, chunk, i == 0, togo.tolist(), int(before[0])))
            togo = before
        return pd.DataFrame(out, columns=["c", "chunk", "last", "togo", "cost"])

    schema = "c string, chunk long, last boolean, togo array<long>, cost long"
    return common.stored(chunks.select("c", "chunk", "matrix").groupBy("c").applyInPandas(run, schema), "turns-togo")


def _walks(marked: DataFrame, togo: DataFrame) -> DataFrame:
    """c, chunk, start, end, edits: each chunk's walk from each state. Stored."""

    def run(key, frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        initials, faults = frame["initial"].tolist(), frame["fault"].tolist()
        table = _table(initials, faults, tuple(int(x) for x in ends["togo"].iloc[0]))
        out = []
        for start in range(4):
            edits, _, end = walk(initials, faults, table, start, bool(ends["last"].iloc[0]))
            out.append((*key, start, end, edits))
        return pd.DataFrame(out, columns=["c", "chunk", "start", "end", "edits"])

    paired = marked.groupBy("c", "chunk").cogroup(togo.groupBy("c", "chunk"))
    return common.stored(paired.applyInPandas(run, "c string, chunk long, start int, end int, edits string"), "turns-walks")


def _chosen(walks: DataFrame) -> DataFrame:
    """c, chunk, start, edits of the walks that follow one another from the first state. Stored."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leads = dict(zip(zip(frame["chunk"], frame["start"], strict=True), frame["end"], strict=True))
        state, out = 0, []
        for chunk in sorted(set(frame["chunk"])):
            out.append((frame["c"].iloc[0], chunk, state))
            state = leads[chunk, state]
        return pd.DataFrame(out, columns=["c", "chunk", "start"])

    taken = walks.select("c", "chunk", "start", "end").groupBy("c").applyInPandas(run, "c string, chunk long, start int")
    return common.stored(walks.join(taken, ["c", "chunk", "start"]).select("c", "chunk", "start", "edits"), "turns-chosen")


def _pieces(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """c, chunk, place, piece: the repaired turns of each chunk as bytes, each turn with a newline after it."""
    names = ["c", "chunk", "place", "piece"]

    def batches_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=names)

    def run(batches):
        own = edits = None
        state = at = place = size = last = 0
        piece: list[bytes] = []
        for batch in batches:
            found = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            for c, chunk, first, start, role, text in rows:
                if first:
                    if piece:
                        found.append((*own, place, b"".join(piece)))
                    own, edits, state, at, place, piece, size = (c, chunk), text, start, 0, 0, [], 0
                    last = len(edits.rstrip("I"))
                    continue
                while at < len(edits):
                    edit, at = edits[at], at + 1
                    if edit != "D":
                        piece.append(f"{_ROLE[state] if edit in 'IR' else role}:{'' if edit == 'I' else text}\n".encode())
                        size += len(piece[-1])
                        state = _AFTER[role[0]][state] if edit == "K" else _NEXT[state]
                    # what is inserted after the last row goes with it
                    if edit != "I" and at < last:
                        break
                if size >= PIECE:
                    found.append((*own, place, b"".join(piece)))
                    place, piece, size = place + 1, [], 0
            if found:
                yield batches_of(found)
        if piece:
            yield batches_of([(*own, place, b"".join(piece))])

    kept = turns.select("c", "chunk", F.lit(False).alias("first"), F.lit(0).alias("start"), "role", "text", "at")
    heads = chosen.select("c", "chunk", F.lit(True).alias("first"), "start", F.lit("").alias("role"), F.col("edits").alias("text"), F.lit(-1).cast("long").alias("at"))
    ordered = kept.unionByName(heads).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "at").drop("at")
    return ordered.mapInArrow(run, "c string, chunk long, place long, piece binary")


def _digests(pieces: DataFrame) -> DataFrame:
    """c, repaired_sha256 of the conversations that have a piece: a digest is that of one stream, read piece by piece."""

    def run(batches):
        own, state = None, None
        for batch in batches:
            found = []
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = piece.as_py()[:-1]
                if c != own:
                    if state is not None:
                        found.append((own, state.hexdigest()))
                    own, state = c, sha256(body)
                else:
                    state.update(b"\n" + body)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["c", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([state.hexdigest()])], names=["c", "repaired_sha256"])

    ordered = pieces.repartition("c").sortWithinPartitions("c", "chunk", "place").select("c", "piece")
    return ordered.mapInArrow(run, "c string, repaired_sha256 string")


def _totals(chunks: DataFrame, togo: DataFrame) -> DataFrame:
    """c, blank, duplicate, truncated, illegal, cost. Chunks meet their successors by a window of one narrow row each."""
    after = F.lead("head").over(Window.partitionBy("c").orderBy("chunk"))
    seam = F.when(F.col("_next").isNotNull() & ~F.concat("tail", "_next").isin("su", "ua", "au"), 1).otherwise(0)
    sums = chunks.withColumn("_next", after).groupBy("c").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + seam).alias("illegal"))
    return sums.join(togo.groupBy("c").agg(F.min_by("cost", "chunk").alias("cost")), "c")


def _large(rows: DataFrame, chunk: int) -> DataFrame:
    """c and what `repair` says, for conversations that no task can hold."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = rows.select("c", "turn", "role", "text", "fault", digest.alias("digest"), F.left("text", F.lit(32)).alias("_head"))
    # the bounds of ranges hold only the beginnings of texts
    ranged = keyed.repartitionByRange("c", F.col("turn").asc_nulls_first(), "role", "_head").sortWithinPartitions("c", *_order()).drop("_head", "turn")
    turns = common.stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.expr(f"at div {chunk}")), "turns")
    marked = _with_duplicates(turns)
    chunks = _summaries(marked)
    togo = _costs_to_go(chunks)
    chosen = _chosen(_walks(marked, togo))
    audits = chosen.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    empty = F.sha2(F.lit(""), 256)
    whole = _totals(chunks, togo).join(audits, "c").join(_digests(_pieces(turns, chosen)), "c", "left")
    return common.stored(whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty)), "turns-large")


def _statistics(rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """conv_id, gaps, n and bytes after the damage, for every id before it. Stored; rows meet as sums for each id and turn."""
    size = F.octet_length(common.text_or_empty("text")).cast("long") + F.octet_length(common.text_or_empty("role"))
    cells = rows.groupBy(F.col(conv).alias("conv_id"), F.col(turn).alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    kind = _kind(F.col("conv_id"), F.col("turn"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    there = F.when(kind != 0, F.col("turn").cast("decimal(20,0)"))
    sums = cells.groupBy("conv_id").agg(
        F.max(there).alias("high"), F.min(there).alias("low"), F.count(there).alias("turns"),
        F.sum(F.col("n") * times).alias("n"), F.sum(F.col("bytes") * times).alias("bytes"),
    )
    gaps = F.least(F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)), F.lit(2**63 - 1)).cast("long")
    return common.stored(sums.select("conv_id", gaps.alias("gaps"), "n", "bytes"), "turn-sizes")


def repair_report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES, chunk: int = CHUNK
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema[conv].dataType.simpleString()
    sizes = _statistics(rows, conv, turn)
    broken = damaged(rows, conv, turn).withColumn("fault", _fault(F.col("text")))
    broken = broken.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")
    large = common.stored(sizes.where((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select(key, F.col("conv_id").alias("id"), "n"), "turns-large-ids")
    if large.isEmpty():
        found = _small(broken, kind)
    else:
        found = _small(common.anti_split(broken, large.select("c", "n"), ["c"], "n"), kind)
        apart = _large(common.join_split(broken, large.select("c", "n"), ["c"], "n").drop("n"), chunk)
        found = found.unionByName(apart.join(large.select("c", F.col("id").alias("conv_id")), "c").select(*found.columns))
    own = F.col("conv_id").eqNullSafe(F.col("_conv"))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return sizes.join(found.withColumnRenamed("conv_id", "_conv"), own, "left").select(
        "conv_id", "gaps", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
