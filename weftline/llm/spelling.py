"""Spelling variants: words one edit apart, grouped around their most frequent forms.

Words are counted over whole texts. Near words are found by an even-partition pigeonhole join: of two words that one
inserted, deleted or replaced code point sets apart, one half of the shorter (or of either, if they are equally long)
is untouched. So every word is indexed by its two halves, whose lengths follow from its own, and probes, for words of its length and of one
less, with its beginning and its end of those lengths. A pair that meets on both halves counts on the
first alone, so that candidates are distinct without a shuffle, and an edit distance of one verifies them.

A bucket (length, half, segment) of more than LARGE words is split further: its words agree in one half, so that near ones have other
halves one edit apart, which meet on what remains when a code point is taken away. Such cells hold no more words
than an alphabet has letters, so that very common beginnings and ends cost no more than their words' lengths. Both ways
give the same pairs (tested).

Each word's form is its near word of the largest count, if that is at least RATIO times its own; forms are followed to
their roots by pointer doubling: counts double at every step, so that the rounds are few.

Edge cases: null texts have no words, a null id is written as an empty string where a checksum names it; the run's own letters
are read by code point; repeated rows count again; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: A checksum that this divides marks a run which loses a code point.
SLIPS = 97
#: Words of one bucket that are compared with one another; larger buckets are split.
LARGE = 64
MAX_ROUNDS = 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words of all texts that occur often enough. Stored."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    held = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    # a run that is too short stays so, whether it loses a code point or not
    held = held.where(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = held.withColumn("h", h).select(F.when(F.col("h") % SLIPS == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return common.stored(counts.where(F.col("n") >= min_count), "words")


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _keys(words: DataFrame, shorter: int) -> DataFrame:
    """Bucket keys (length, half, segment) of the words, for words of `shorter` code points less, with the other part `rest`."""
    length = F.length("word") - shorter
    first, last = _half(length), length - _half(length)
    size = F.length("word")
    entry = lambda half, segment, rest: F.struct(length.alias("length"), F.lit(half).alias("half"), segment.alias("segment"), rest.alias("rest"))
    begin = entry(0, F.left("word", first), F.substring("word", first + 1, size))
    end = entry(1, F.right("word", last), F.left("word", size - last))
    return words.select("word", "n", F.explode(F.array(begin, end)).alias("k")).select("word", "n", "k.*")


def _met_before(a: Column, b: Column) -> Column:
    """Whether the pair (a shorter or equally long) meets on its first halves too."""
    first = _half(F.length(a))
    return F.left(a, first) == F.left(b, first)


def _less_one(rest: Column, places: bool) -> Column:
    """What remains of `rest` without one code point, with its place or, each once, without."""
    drop = lambda i: F.concat(F.left(rest, i - 1), F.substring(rest, i + 1, F.length(rest)))
    every = F.sequence(F.lit(1), F.length(rest))
    if places:
        return F.transform(every, lambda i: F.struct(i.alias("place"), drop(i).alias("left")))
    return F.array_distinct(F.transform(every, drop))


_BUCKET = ["length", "half", "segment"]


def near_pairs(words: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, na, b, nb), each pair of near words once: a is the shorter, or the lesser of two of one length. Stored."""
    index, probe = _keys(words, 0), _keys(words, 1)
    buckets = index.select(*_BUCKET, F.lit(1).alias("i"), F.lit(0).alias("p")).unionByName(probe.select(*_BUCKET, F.lit(0).alias("i"), F.lit(1).alias("p")))
    sizes = buckets.groupBy(*_BUCKET).agg(F.sum("i").alias("indexed"), F.sum("p").alias("probing"))
    # a bucket that no second word meets has no pair
    sizes = sizes.where("indexed > 1 OR indexed > 0 AND probing > 0").withColumn("members", F.col("indexed") + F.col("probing"))
    sizes = common.stored(sizes.select(*_BUCKET, "members"), "word-buckets")
    x = common.join_split(index, sizes, _BUCKET, "members")
    y = common.join_split(probe, sizes, _BUCKET, "members")
    x, y = common.stored(x, "word-index"), common.stored(y, "word-probe")

    left = lambda t: t.select(*t.columns[:-4], F.col("word").alias("a"), F.col("n").alias("na"))
    right = lambda t: t.select(*t.columns[:-4], F.col("word").alias("b"), F.col("n").alias("nb"))
    narrow = lambda t, *more: t.select(*_BUCKET, *more, "rest", "members", "word", "n")
    few = F.col("members") <= large

    small_x, small_y = narrow(x.where(few)), narrow(y.where(few))
    same = left(small_x).join(right(small_x), _BUCKET).where("a < b")
    longer = left(small_x).join(right(small_y), _BUCKET)
    met = same.unionByName(longer).where(F.levenshtein("a", "b", 1) == 1)

    many_x, many_y = x.where(~few), y.where(~few)
    spread = narrow(many_x.withColumn("cut", F.explode(_less_one(F.col("rest"), True))), "cut")
    met = met.unionByName(left(spread).join(right(spread), [*_BUCKET, "cut"]).where("a < b").drop("cut"))
    whole = narrow(many_x.withColumn("cut", F.col("rest")), "cut")
    lessened = narrow(many_y.withColumn("cut", F.explode(_less_one(F.col("rest"), False))), "cut")
    met = met.unionByName(left(whole).join(right(lessened), [*_BUCKET, "cut"]).drop("cut"))

    once = met.where((F.col("half") == 0) | ~_met_before(F.col("a"), F.col("b")))
    return common.stored(once.select("a", "na", "b", "nb"), "word-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), stored, whose chains end: where following the forms ends."""
    found = common.stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    for _ in range(MAX_ROUNDS):
        # how many words lead to a word says how hot it is in the join
        led = found.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        ahead = common.stored(led.join(found.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "word-ahead")
        if ahead.isEmpty():
            return found
        moved = common.join_split(found, ahead, ["root"], "members").select("word", F.col("next").alias("root"))
        ended = common.anti_split(found, ahead, ["root"], "members").select("word", "root")
        found = common.stored(moved.unionByName(ended), "word-roots")
    raise RuntimeError("forms did not end")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, ratio: float = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = counted(docs, id_col, text_col)
    pairs = near_pairs(words, large)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("own"), F.col("a").alias("other"), F.col("na").alias("m"))
    )
    best = both.groupBy("word").agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("f"))
    fits = -F.col("f.m") >= F.col("own") * F.lit(ratio)
    near = best.select("word", "n_near", F.when(fits, F.col("f.other")).alias("form"), F.when(fits, -F.col("f.m")).alias("form_n"))
    near = common.stored(near, "word-near")
    ends = roots(near.where("form IS NOT NULL"))
    return (
        words.join(near, "word", "left")
        .join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
