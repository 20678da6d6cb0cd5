"""Removal of repeated word windows by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the least hash of the M-word runs inside it;
consecutive windows that share one occurrence of a minimiser form a super-k-mer, a span of at most
2K - M words. Equal windows have equal minimisers, so that

1. spans whose minimiser occurs only once can't hold a repeated window and go no further;
2. equal spans (same minimiser, same two hashes) are all repeats; one of them stands for the rest;
3. of minimisers with several different spans, each span's words travel as one packed string to the
   minimiser's bucket, where sorting the windows counts them exactly.

A minimiser with more than `LARGE` different spans is not held in one task: its windows are counted
by an ordinary aggregation keyed by the window itself, with the same result. Joins on minimisers, spans
and windows broadcast the few heavy keys, so that none meets in one task. The ranges found return to
their texts, and every word that a repeated window covers is removed, at each of its places.

Edge cases: null texts have no words; texts of fewer than K words keep all of them; a window repeated
within one text counts; rows that repeat an id or a text are texts of their own, so all their windows
are repeated; an empty table gives an empty result. Columns other than doc_id and text are ignored. Rows
are known by their place in the scan and read again: `docs` must be a stored table, or read alike each time.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, wordhash

K = 35
M = 5
#: Turns words' hashes into others for the second hash of a span.
_SECOND = np.uint64(0x632BE59BD9B4E019)
#: Different spans of a minimiser that one task may sort together.
LARGE = 2000


def super_kmers(words: wordhash.Words, k: int = K, m: int = M):
    """(text, start, windows, minimiser, two hashes of the span) arrays of all super-k-mers; starts count from the text's first word."""
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, *(np.zeros(0, np.uint64) for _ in range(3))
    runs = wordhash.sequence_hashes(words.hashes, m)
    span = k - m + 1
    best, width = np.arange(len(runs)), 1
    while width * 2 <= span:
        a, b = best[:-width], best[width:]
        best = np.where(runs[a] <= runs[b], a, b)
        width *= 2
    if width < span:
        a, b = best[: len(best) - (span - width)], best[span - width :]
        best = np.where(runs[a] <= runs[b], a, b)
    whole = np.arange(len(best)) + k <= words.last_of_text()[: len(best)]
    # a window that crosses into the next text ends the run before it
    new = whole.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(new)
    stops = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]])) + 1
    text = np.searchsorted(words.first, starts, "right") - 1
    minimiser = runs[best[starts]]
    spans = (wordhash.SpanHashes(h).of(starts, stops + k - 1) for h in (words.hashes, wordhash.mix(words.hashes ^ _SECOND)))
    return text, starts - words.first[text], stops - starts, minimiser, *spans


def _spans(docs: DataFrame, k: int, m: int) -> DataFrame:
    """row, start, n, mini, span, check of every super-k-mer, stored."""

    def cut(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for low, high in wordhash.slices(batch.column("text")):
                text, start, n, mini, span, check = super_kmers(wordhash.words_of(batch.column("text").slice(low, high - low)), k, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[low + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *map(wordhash.signed, (mini, span, check))],
                    names=["row", "start", "n", "mini", "span", "check"],
                )

    return common.stored(docs.select("row", "text").mapInArrow(cut, "row long, start int, n int, mini long, span long, check long"), "spans")


def _packed(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The words of the wanted spans as one string each: row, start, n, mini, c, kinds, words. Stored.

    wanted: row, start, n, mini, c, kinds. Of one text, the spans are gathered; they are bounded by its length.
    """
    per_text = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "mini", "c", "kinds")).alias("w"))

    def pack(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "start", "n", "mini", "c", "kinds", "words")}
            for row, text, asked in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "w")), strict=True):
                words = text.encode().split()
                for x in asked:
                    out["row"].append(row)
                    for c in ("start", "n", "mini", "c", "kinds"):
                        out[c].append(x[c])
                    out["words"].append(b" ".join(words[x["start"] : x["start"] + x["n"] + k - 1]))
                if len(out["row"]) > 20_000:
                    yield _span_batch(out)
                    out = {c: [] for c in out}
            yield _span_batch(out)

    joined = docs.select("row", "text").join(per_text, "row")
    return common.stored(joined.mapInArrow(pack, "row long, start int, n int, mini long, c long, kinds long, words binary"), "packed")


def _span_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"start": pa.int32(), "n": pa.int32(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))


def windows_of(words: bytes, k: int) -> list[bytes]:
    """All windows of k words of a packed string."""
    ends = [i for i, b in enumerate(words) if b == 0x20] if len(words) < 64 else np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(words))
    return [words[starts[i] : ends[i + k - 1]] for i in range(len(starts) - k + 1)]


def _runs(hit: list[int]):
    """Maximal runs (first, length) of ascending numbers."""
    first = before = None
    for i in hit:
        if first is None:
            first = i
        elif i != before + 1:
            yield first, before - first + 1
            first = i
        before = i
    if first is not None:
        yield first, before - first + 1


def _repeats_in_group(group: list[tuple], k: int):
    """(row, start, n) ranges of repeated windows of the spans (row, start, c, words) of one minimiser."""
    listed = sorted((w, i, j) for i, (_, _, _, words) in enumerate(group) for j, w in enumerate(windows_of(words, k)))
    hits: dict[int, list[int]] = {}
    low = 0
    while low < len(listed):
        high = low + 1
        while high < len(listed) and listed[high][0] == listed[low][0]:
            high += 1
        if high - low > 1:
            for _, i, j in listed[low:high]:
                hits.setdefault(i, []).append(j)
        low = high
    for i, found in hits.items():
        row, start, c, _ = group[i]
        if c == 1:  # spans that occur twice are repeats anyway
            for a, n in _runs(sorted(found)):
                yield row, start + a, n


_RANGES = "row long, start int, n int"


def _range_batch(found: list[tuple]) -> pa.RecordBatch:
    row, start, n = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["row", "start", "n"])


def _in_buckets(packed: DataFrame, k: int) -> DataFrame:
    """Repeated ranges of the spans of each minimiser, sorted minimiser by minimiser within buckets."""

    def count(batches):
        mini, group = None, []
        for batch in batches:
            found: list[tuple] = []
            for m, row, start, c, words in zip(*(batch.column(x).to_pylist() for x in ("mini", "row", "start", "c", "words")), strict=True):
                if m != mini:
                    found += _repeats_in_group(group, k)
                    mini, group = m, []
                group.append((row, start, c, words))
            yield _range_batch(found)
        yield _range_batch(list(_repeats_in_group(group, k)))

    narrow = packed.select("mini", "row", "start", "c", "words")
    return narrow.repartition("mini").sortWithinPartitions("mini").mapInArrow(count, _RANGES)


def _by_window(packed: DataFrame, k: int) -> DataFrame:
    """Repeated ranges of the spans of very common minimisers: one row per window, counted by its digest."""

    def spread(batches):
        for batch in batches:
            digest, rows, starts, counts = [], [], [], []
            for row, start, c, words in zip(*(batch.column(x).to_pylist() for x in ("row", "start", "c", "words")), strict=True):
                for j, w in enumerate(windows_of(words, k)):
                    digest.append(blake2b(w, digest_size=16).digest())
                    rows.append(row)
                    starts.append(start + j)
                    counts.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int64())],
                names=["w", "row", "start", "c"],
            )

    windows = common.stored(packed.select("row", "start", "c", "words").mapInArrow(spread, "w binary, row long, start int, c long"), "windows")
    repeated = windows.groupBy("w").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("rows")).where(F.col("all") > 1).select("w", "rows")
    found = common.join_split(windows.where("c = 1"), common.stored(repeated, "repeated"), ["w"], "rows")
    return found.select("row", "start", F.lit(1).alias("n"))


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M, large: int = LARGE) -> DataFrame:
    """row, start, n: n windows from word `start` of the text in `row` are repeated somewhere. docs: row, text."""
    spans = _spans(docs, k, m)
    met = common.stored(spans.groupBy("mini").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > 1), "met")
    spans = common.stored(common.join_split(spans, met, ["mini"], "all").drop("all"), "spans")
    same = ["mini", "span", "check"]
    kinds = common.stored(spans.groupBy(*same).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n")).alias("one")), "kinds")
    repeated = common.stored(kinds.where("c > 1").select(*same, "c"), "repeated")
    equal = common.join_split(spans, repeated, same, "c").select("row", "start", "n")
    several = common.stored(kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1), "several")
    wanted = common.join_split(kinds.select("one", "mini", "c"), several, ["mini"], "kinds")
    packed = _packed(docs, wanted.select("one.*", "mini", "c", "kinds"), k)
    found = _in_buckets(packed.where(F.col("kinds") <= large), k)
    common_ones = packed.where(F.col("kinds") > large)
    return equal.unionByName(found).unionByName(_by_window(common_ones, k))


def _cleaned(words: list[bytes], ranges, k: int) -> list[bytes]:
    covered = np.zeros(len(words) + 1, np.int32)
    for start, n in ranges:
        covered[start] += 1
        covered[start + n + k - 1] -= 1
    keep = np.cumsum(covered[:-1]) == 0
    return [w for w, kept in zip(words, keep.tolist(), strict=True) if kept]


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, large: int = LARGE) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the remaining words joined by one space."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", common.text_or_empty().alias("text"))
    ranges = common.stored(repeated_ranges(keyed, k, m, large), "ranges")
    # a text's ranges are at most as many as its words
    per_text = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def clean(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = text.encode().split()
                left = _cleaned(words, [(r["start"], r["n"]) for r in found], k) if found else words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = keyed.join(per_text, "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(clean, f"doc_id {id_kind}, n_words long, n_removed long, kept string")


def repeat_report(docs: DataFrame, k: int = K, m: int = M, large: int = LARGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(docs, k, m, large).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
