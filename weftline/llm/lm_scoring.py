"""Cross-entropy difference of matched n-gram models.

Two interpolated bigram models, one of the target documents and one of all documents (the background),
share one vocabulary, order and smoothing. Their per-token losses on a document, subtracted and averaged,
score it: the higher, the more it resembles the target.

The vocabulary is every word of all documents, and every pair of words that occurs twice counts in the
models, however many there are (a pair that occurs once would only predict itself). A token's loss is that
of an unseen word, less what its word's counts take off, less what its pair's counts take off. The words
and pairs that occur most often are broadcast and scored where the texts are read; occurrences of all
others travel packed, by ranges of the key's hash, to where the range's gains are, and what they take off
comes back summed by document. How much is broadcast affects cost only. A word or pair that is not broadcast
is rarer than all those that are, so that no range holds a hot one.

Edge cases: null and wordless texts have no tokens, losses and score of 0; very long texts score over
all tokens; repeated rows count and score one by one; without target documents both models are the
background, and scores are 0; an empty table gives an empty result. Other columns are ignored. Rows are
known by their place in the scan: `docs` must be a stored table, or read alike each time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, wordhash

#: A pair counts in the models from so many occurrences.
MIN_PAIR_COUNT = 2
#: Words and pairs that are broadcast; all others are looked up by shuffling.
HEAD_WORDS = 200_000
MAX_PAIRS = 1_000_000
#: Target ids that are broadcast while words and pairs are counted; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Shares of pair, single-word and uniform probability.
WEIGHTS = (0.6, 0.3, 0.1)

#: The number of a text's start; broadcast words have the numbers from 1, all others negative ones made of their hash.
START = 0
#: Entries that a task gathers before it passes them on.
_GATHER = 1_000_000
#: Bytes of text that a task cuts into words at once; a longer text is cut alone.
_SLICE = 1 << 20
#: Hash ranges to a shuffle partition when rare words and pairs are looked up.
RANGES = 4

_U = np.uint64
_TOP = _U(1 << 63)
_PAIR = _U(0xA24BAED4963EE407)
MODELS = ("target", "background")
COUNTS = ("n", "t", "last_n", "last_t")


@dataclass
class Models:
    """Losses in nats, each array's first axis being the model (target, background).

    words: sorted hashes of the broadcast words; unseen: an unseen word's loss; singles: what a broadcast word
    takes off it (START first); keys, gains: sorted keys of the broadcast pairs, and what they take off.
    """

    words: np.ndarray
    unseen: float
    singles: np.ndarray
    keys: np.ndarray
    gains: np.ndarray

    @cached_property
    def head(self) -> wordhash.Finder:
        return wordhash.Finder(self.words)

    @cached_property
    def _pairs(self) -> wordhash.Finder:
        return wordhash.Finder(self.keys)

    def known(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair keys, their places among the broadcast ones, which pairs are known here)."""
        key = pair_keys(before, word)
        return key, *self._pairs.find(key)

    def losses(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Per-token losses as far as they are known here."""
        losses = self.unseen - self.singles[:, np.maximum(word, START)]
        _, at, known = self.known(before, word)
        if known.any():
            losses[:, known] -= self.gains[:, at[known]]
        return losses


def word_numbers(hashes: np.ndarray, head: wordhash.Finder) -> np.ndarray:
    at, found = head.find(hashes)
    return np.where(found, at + np.int64(1), (hashes | _TOP).view(np.int64))


def numbers(words: wordhash.Words, head: wordhash.Finder) -> tuple[np.ndarray, np.ndarray]:
    """(before, word): each token's number and that of the token before it in its text. head: of the broadcast words' hashes."""
    word = word_numbers(words.hashes, head)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = words.first[:-1]
    before[starts[starts < words.first[1:]]] = START
    return before, word


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return wordhash.mix(wordhash.mix(before.view(_U) + _PAIR) * _PAIR + word.view(_U)).view(np.int64)


def with_target(docs: DataFrame, target_ids: DataFrame, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """text, target (whether the document's id is among target_ids) of every document.

    Counted ids are broadcast, so that no text moves; more than `broadcast` of them are joined by shuffling,
    and the texts then written, since they are read twice.
    """
    ids = common.stored(target_ids.select(F.col("doc_id").alias("_id")).distinct().withColumn("_t", F.lit(True)), "targets")
    few = ids.count() <= broadcast
    ids = F.broadcast(ids) if few else ids.hint("merge")
    flagged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_t").isNotNull().alias("target"))
    return flagged if few else common.stored(flagged, "flagged")


def word_counts(flagged: DataFrame) -> DataFrame:
    """word (hash), n, last_n (how often it ends a text) in all documents, t, last_t in target documents. Stored."""

    def count(batches):
        for batch in batches:
            texts, target = batch.column("text"), np.array(batch.column("target").to_pylist(), bool)
            for low, high in wordhash.slices(texts, _SLICE):
                words = wordhash.words_of(texts.slice(low, high - low), lower=True)
                size, of_target = words.counts(), target[low:high]
                word, inverse = np.unique(words.hashes, return_inverse=True)
                last, in_target = inverse[words.first[1:][size > 0] - 1], np.repeat(of_target, size)
                sums = (np.bincount(x, minlength=len(word)) for x in (inverse, inverse[in_target], last, last[of_target[size > 0]]))
                yield pa.RecordBatch.from_arrays([wordhash.signed(word), *(pa.array(x.astype(np.int64)) for x in sums)], names=["word", *COUNTS])

    counts = flagged.mapInArrow(wordhash.lean(count), "word long, n long, t long, last_n long, last_t long")
    return common.stored(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")


def head_words(counts: DataFrame, most: int = HEAD_WORDS) -> np.ndarray:
    """Sorted hashes of the most frequent words; none of those that occur once."""
    kept = common.most_frequent(counts, 2, most).select("word").toArrow()
    return np.sort(kept.column("word").to_numpy().astype(np.int64).view(_U))


def with_numbers(counts: DataFrame, head: np.ndarray) -> DataFrame:
    """The counts with words' numbers in place of their hashes."""
    shared = counts.sparkSession.sparkContext.broadcast(head)

    def renumber(batches):
        finder = wordhash.Finder(shared.value)
        for batch in batches:
            number = word_numbers(np.ascontiguousarray(batch.column("word").to_numpy()).view(_U), finder)
            yield pa.RecordBatch.from_arrays([pa.array(number), *(batch.column(c) for c in COUNTS)], names=["word", *COUNTS])

    return common.stored(counts.select("word", *COUNTS).mapInArrow(wordhash.lean(renumber), counts.schema), "numbered")


def pair_counts(flagged: DataFrame, head: np.ndarray) -> DataFrame:
    """before, word, n (in all documents), t (in target documents) of every pair that occurs MIN_PAIR_COUNT times. Stored."""
    shared = flagged.sparkSession.sparkContext.broadcast(head)

    def merged(parts):
        key, before, word, n, t = (np.concatenate(x) for x in zip(*parts))
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        n, t = (np.bincount(inverse, x, len(key)).astype(np.int64) for x in (n, t))
        return key, before[first], word[first], n, t

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)[1:]], names=["before", "word", "n", "t"])

    def count(batches):
        finder, parts, held = wordhash.Finder(shared.value), [], 0
        for batch in batches:
            texts, target = batch.column("text"), np.array(batch.column("target").to_pylist(), bool)
            for low, high in wordhash.slices(texts, _SLICE):
                words = wordhash.words_of(texts.slice(low, high - low), lower=True)
                before, word = numbers(words, finder)
                of_target = np.repeat(target[low:high], words.counts())
                parts.append(merged([(pair_keys(before, word), before, word, np.ones(len(word)), of_target.astype(float))]))
                held += len(parts[-1][0])
                if held > _GATHER // 2:
                    yield batch_of(parts)
                    parts, held = [], 0
        if held:
            yield batch_of(parts)

    counted = flagged.select("text", "target").mapInArrow(wordhash.lean(count), "before long, word long, n long, t long")
    summed = counted.groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return common.stored(summed.where(F.col("n") >= MIN_PAIR_COUNT), "pairs")


def _joined(rows: DataFrame, counts: DataFrame, on: str) -> DataFrame:
    """Adds the counts of a word: those of broadcast words (and START) are at most HEAD_WORDS + 1, others are joined by shuffling."""
    head = rows.where(F.col(on) >= START).join(F.broadcast(counts.where(F.col(on) >= START)), on)
    return head.unionByName(rows.where(F.col(on) < START).join(counts.where(F.col(on) < START), on))


def single_probability(count: Column, total: int, size: int) -> Column:
    return WEIGHTS[1] * count / F.lit(float(max(total, 1))) + F.lit(WEIGHTS[2] / max(size, 1))


def gains_of(words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(word gains, pair gains, the loss of an unseen word) from stored counts of words (word, n, t, last_n, last_t) and pairs. Both stored.

    Word gains: word, target, background. Pair gains: before, word, n, target, background. A word is a
    context as often as it occurs without ending a text; the start of a text is one for each text with words.
    Counts are exact; their gains are rounded to floats here, before any part of them is broadcast or shuffled.
    """
    sums = words.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS)).first()
    size, n, t, starts_n, starts_t = sums
    start = words.sparkSession.createDataFrame([(START, starts_n, starts_t)], "before long, context_n long, context_t long")
    contexts = words.select(F.col("word").alias("before"), (F.col("n") - F.col("last_n")).alias("context_n"), (F.col("t") - F.col("last_t")).alias("context_t"))
    singles = words.select("word", F.col("n").alias("single_n"), F.col("t").alias("single_t"))
    kinds = {"target": "t", "background": "n"} if t else dict.fromkeys(MODELS, "n")
    base = {m: single_probability(F.col(f"single_{c}"), t if c == "t" else n, size) for m, c in kinds.items()}
    unseen = WEIGHTS[2] / max(size, 1)
    word_gains = singles.select("word", *(F.log(base[m] / F.lit(unseen)).cast("float").alias(m) for m in MODELS))
    joined = _joined(_joined(pairs, contexts.unionByName(start), "before"), singles, "word")
    gain = {m: F.log1p(WEIGHTS[0] * F.col(c) / F.greatest(F.col(f"context_{c}"), F.lit(1)) / base[m]) for m, c in kinds.items()}
    gains = joined.select("before", "word", "n", *(gain[m].cast("float").alias(m) for m in MODELS))
    return common.stored(word_gains, "word-gains"), common.stored(gains, "pair-gains"), float(-np.log(unseen))


def _columns(found: pa.Table, *names: str) -> list[np.ndarray]:
    return [found.column(c).to_numpy() for c in names]


def fit(docs: DataFrame, target_ids: DataFrame, max_words: int = HEAD_WORDS, max_pairs: int = MAX_PAIRS) -> tuple[Models, DataFrame, DataFrame]:
    """The broadcast part of both models, and the gains of the words and of the pairs that are too many to broadcast.

    target_ids: the ids (doc_id) of target documents.
    """
    with common.cleared(docs.sparkSession, "word-gains", "pair-gains"):
        flagged = with_target(docs, target_ids)
        counts = word_counts(flagged)
        head = head_words(counts, max_words)
        words, pairs, unseen = gains_of(with_numbers(counts, head), pair_counts(flagged, head))
    # one row per broadcast word: bounded by max_words
    number, *gains = _columns(words.where(F.col("word") > START).toArrow(), "word", *MODELS)
    singles = np.zeros((2, len(head) + 1))
    singles[:, number] = gains
    inside = pairs.where((F.col("before") >= START) & (F.col("word") > START))
    kept = common.most_frequent(inside, MIN_PAIR_COUNT, max_pairs).toArrow()
    rest = pairs
    if kept.num_rows:
        least = int(kept.column("n").to_numpy().min())
        rest = pairs.where((F.col("before") < START) | (F.col("word") < START) | (F.col("n") < least))
    keys = pair_keys(*(x.astype(np.int64) for x in _columns(kept, "before", "word")))
    order = np.argsort(keys)
    models = Models(head, unseen, singles, keys[order], np.array(_columns(kept, *MODELS)).reshape(2, -1)[:, order])
    return models, words.where(F.col("word") < START), rest


def _packs(low_bits: np.uint64, key: np.ndarray, *others: np.ndarray) -> list[pa.Array]:
    """One row for each range of the keys' hash: the range, and its keys and other values as bytes."""
    ranges = wordhash.mix(np.ascontiguousarray(key, np.int64).view(_U)) >> low_bits
    order = np.argsort(ranges, kind="stable")
    found, first = np.unique(ranges[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    columns = [x[order] for x in (key, *others)]
    return [pa.array(found.astype(np.int64)), *(pa.array([c[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for c in columns)]


def _packed_gains(gains: DataFrame, low_bits: np.uint64) -> DataFrame:
    """part, keys, target, background: the gains of words (word) or pairs (before, word), packed by range of the key's hash."""
    of_pairs = "before" in gains.columns

    def pack(batches):
        held, size = [], 0

        def packed():
            return pa.RecordBatch.from_arrays(_packs(low_bits, *map(np.concatenate, zip(*held))), names=["part", "keys", *MODELS])

        for batch in batches:
            number = batch.column("word").to_numpy()
            key = pair_keys(batch.column("before").to_numpy(), number) if of_pairs else number
            held.append((key, *(batch.column(m).to_numpy() for m in MODELS)))
            size += len(key)
            if size > _GATHER:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    wanted = gains.select(*["before"] * of_pairs, "word", *MODELS)
    return wanted.mapInArrow(wordhash.lean(pack), "part long, keys binary, target binary, background binary")


def _gains(tails: DataFrame, words: DataFrame, pairs: DataFrame, low_bits: np.uint64) -> DataFrame:
    """row, less_target, less_background: what the words and pairs that are not broadcast take off the losses. Stored. tails: part, keys, rows."""

    def table(parts):
        keys, t, n = (np.frombuffer(b"".join(p[i] for p in parts), kind) for i, kind in enumerate(("<i8", "<f4", "<f4")))
        order = np.argsort(keys)
        return wordhash.Finder(keys[order]), t[order], n[order]

    def summed(held):
        rows, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return rows, *(np.bincount(inverse, np.concatenate([h[i] for h in held]), len(rows)) for i in (1, 2))

    def packed_sums(held):
        return pa.RecordBatch.from_arrays(_packs(low_bits, *summed(held)), names=["part", "rows", "target", "background"])

    def look_up(batches):
        own, parts, known, held, size = None, [], None, [], 0
        for batch in batches:
            for part, keys, t, n, rows in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", *MODELS, "rows")), strict=True):
                if part != own:
                    own, parts, known = part, [], None
                if rows is None:
                    parts.append((keys, t, n))
                    continue
                known = known or table(parts)
                at, hit = known[0].find(np.frombuffer(keys, "<i8"))
                if not hit.any():
                    continue
                at = at[hit]
                held.append((np.frombuffer(rows, "<i8")[hit], known[1][at].astype("<f8"), known[2][at].astype("<f8")))
                size += len(at)
                if size > _GATHER:
                    yield packed_sums(held)
                    held, size = [], 0
        if size:
            yield packed_sums(held)

    def add(batches):
        own, held, size = None, [], 0

        def total():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], names=["row", "less_target", "less_background"])

        for batch in batches:
            for part, rows, target, background in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "target", "background")), strict=True):
                if part != own and held:
                    yield total()
                    held, size = [], 0
                own = part
                held.append((np.frombuffer(rows, "<i8"), np.frombuffer(target, "<f8"), np.frombuffer(background, "<f8")))
                size += len(held[-1][0])
                if size > _GATHER:
                    held, size = [summed(held)], 0
        if held:
            yield total()

    gains = _packed_gains(words, low_bits).unionByName(_packed_gains(pairs, low_bits)).withColumn("rows", F.lit(None).cast("binary"))
    met = gains.unionByName(tails, allowMissingColumns=True).withColumn("late", F.col("rows").isNotNull())
    ordered = met.repartition("part").sortWithinPartitions("part", "late").drop("late")
    changes = ordered.mapInArrow(wordhash.lean(look_up), "part long, rows binary, target binary, background binary")
    by_text = changes.repartition("part").sortWithinPartitions("part")
    return common.stored(by_text.mapInArrow(wordhash.lean(add), "row long, less_target double, less_background double"), "changes")


def score(docs: DataFrame, models: Models, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document; losses are means per token."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low_bits = _U(64 - max(4, (RANGES * partitions).bit_length()))
    tail_words, elsewhere = not words.isEmpty(), not (words.isEmpty() and pairs.isEmpty())

    def tokens_of(batch):
        """(rows' places, tokens of each, before, word) by slices of a batch's texts."""
        for low, high in wordhash.slices(batch.column("text"), _SLICE):
            found = wordhash.words_of(batch.column("text").slice(low, high - low), lower=True)
            yield low, high, found.counts(), *numbers(found, shared.value.head)

    def losses(batches):
        for batch in batches:
            for low, high, n, before, word in tokens_of(batch):
                doc = np.repeat(np.arange(high - low), n)
                sums = [np.bincount(doc, x, high - low) for x in shared.value.losses(before, word)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("doc_id", "row")), pa.array(n.astype(np.int64)), *map(pa.array, sums)],
                    names=["doc_id", "row", "n_tokens", *MODELS],
                )

    def unknown(batches):
        held, size = [], 0

        def packed():
            return pa.RecordBatch.from_arrays(_packs(low_bits, *map(np.concatenate, zip(*held))), names=["part", "keys", "rows"])

        for batch in batches:
            place = batch.column("row").to_numpy()
            for low, high, n, before, word in tokens_of(batch):
                key, _, known = shared.value.known(before, word)
                where, tail = np.repeat(place[low:high], n), word < START
                held.append((key[~known], where[~known]))
                if tail_words:
                    held.append((word[tail], where[tail]))
                size += sum(len(x) for x, _ in held[-1 - tail_words :])
                if size > _GATHER:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = rows.mapInArrow(wordhash.lean(losses), f"doc_id {kind}, row long, n_tokens long, target double, background double")
    if elsewhere:
        # the texts are read twice, so that what travels is written once only, by the shuffle
        gains = _gains(rows.select("row", "text").mapInArrow(wordhash.lean(unknown), "part long, keys binary, rows binary"), words, pairs, low_bits)
        scored = scored.join(gains, "row", "left").withColumns(
            {c: F.col(c) - F.coalesce(F.col(f"less_{c}"), F.lit(0.0)) for c in MODELS}
        )
    tokens = F.greatest("n_tokens", F.lit(1))
    means = scored.select("doc_id", "n_tokens", (F.col("target") / tokens).alias("target_loss"), (F.col("background") / tokens).alias("background_loss"))
    return means.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, max_words: int = HEAD_WORDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    return score(docs, *fit(docs, target_ids, max_words, max_pairs))
