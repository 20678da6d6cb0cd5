"""Document fingerprints by a threshold-scaled sketch.

A sketch keeps every hash of a text's distinct five-word shingles that lies below a fixed fraction
of the hash range, an eighth. Where that is fewer than LEAST hashes, the sketch takes the next of the nested
FRACTIONS below which there are as many, in the end all. What a sketch keeps so depends on the set of hashes alone, and
the sketch of two texts together follows from theirs: a larger set never needs a wider range. Sketches compare on the range that both cover, however unequal their
documents are. `upto` is the end of a sketch's range, and the first number of the fingerprint string, so
that likeness and containment follow from two strings alone.

Only DataFrame functions run here. The one ordering of all documents (each document's follower by
descending id) is made on narrow rows: they are dealt by range, followed within each range, and the
ranges' ends are joined to the next range's start. Text moves once, keyed by row, and a third of it
once more as the prefixes that the edited texts need.

Edge cases: a null text counts as empty; texts with fewer than five words have one shingle, the whole
word sequence; texts without words have an empty sketch, alike to another such (1.0) and unlike all
others (0.0); null ids come last in descending order; repeated rows follow one another; a table of
one row follows itself; an empty table gives an empty result. Other columns are ignored. Rows are known
by their place in the scan and read twice: `docs` must be a stored table, or read alike each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

SHINGLE = 5
#: Sketches keep one hash in so many: the first for which that leaves LEAST hashes, or the last.
FRACTIONS = (8, 4, 2, 1)
LEAST = 16

_LEAST = -(2**63)


def _end(one_in: int) -> int:
    """The last of the kept hashes. Hashes are signed, so that the kept range starts at the least long."""
    return _LEAST + 2**64 // one_in - 1


def ranged(hashes: Column, upto: Column | None = None) -> Column:
    """The sketch of ascending hashes that are complete up to `upto` (everything, if there is none)."""
    whole = F.lit(_end(1)) if upto is None else upto
    # LEAST hashes lie in a range if the last of them does
    last = F.get(hashes, F.lit(LEAST - 1))
    for one_in in reversed(FRACTIONS[:-1]):
        whole = F.when(F.coalesce(last <= F.lit(_end(one_in)), F.lit(False)), F.least(F.lit(_end(one_in)), whole)).otherwise(whole)
    return F.struct(F.filter(hashes, lambda h: h <= whole).alias("hashes"), whole.alias("upto"))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the struct `out` of `hashes` (ascending) and `upto` for the string column `text`."""
    words, hashes, every = f"_{out}_words", f"_{out}_hashes", f"_{out}_all"
    df = df.withColumn(words, F.split(F.btrim(F.regexp_replace(F.lower(F.col(text)), common.WS, " ")), " "))
    df = df.withColumn(hashes, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    size = F.size(hashes)
    shingle = F.transform(
        F.sequence(F.lit(0), size - SHINGLE),
        lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(SHINGLE)]),
    )
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(every, F.sort_array(F.array_distinct(F.when(size >= SHINGLE, shingle).when(size > 0, few).otherwise(none))))
    return df.withColumn(out, ranged(F.col(every))).drop(words, hashes, every)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together: the same as that of their union."""
    upto = F.least(a["upto"], b["upto"])
    return ranged(F.filter(F.sort_array(F.array_union(a["hashes"], b["hashes"])), lambda h: h <= upto), upto)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    upto = F.least(a["upto"], b["upto"])
    x, y = (F.filter(s["hashes"], lambda h: h <= upto) for s in (a, b))
    return F.size(x), F.size(y), F.size(F.array_intersect(x, y))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches' shingle sets."""
    x, y, both = _common(a, b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(both / (x + y - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    x, _, both = _common(a, b)
    return F.when(x == 0, F.lit(1.0)).otherwise(both / x)


def fingerprint(sketch: Column) -> Column:
    """The sketch as numbers of 16 hexadecimal digits: `upto`, then the hashes, ascending as signed numbers."""
    return F.array_join(F.transform(F.concat(F.array(sketch["upto"]), sketch["hashes"]), lambda h: F.lpad(F.hex(h), 16, "0")), " ")


def followers(rows: DataFrame) -> DataFrame:
    """Adds next_row to narrow rows with (row, doc_id): next in descending doc_id, the first after the last."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = common.stored(dealt, "ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    led = dealt.withColumns({"next_row": F.lead("row").over(inside), "place": F.row_number().over(inside)})
    # one row per range: as many as the shuffle has partitions
    firsts = led.where("place = 1").select("part", F.col("row").alias("first"))
    ring = Window.orderBy("part")
    ends = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(ring), F.first("first").over(ring.rowsBetween(Window.unboundedPreceding, 0))).alias("start_of_next"),
    )
    return led.join(ends, "part").select(*rows.columns, F.coalesce("next_row", "start_of_next").alias("next_row"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", common.text_or_empty().alias("text"))
    keyed = with_sketch(rows, "text", "sketch").repartition("row")
    narrow = rows.select("row", "doc_id", F.floor(F.length("text") / 3).cast("int").alias("cut"))
    pairs = common.stored(followers(narrow), "followers").select(F.col("row").alias("target"), "next_row", "cut")
    parts = keyed.join(pairs, F.col("row") == F.col("next_row")).select(
        "target", "cut", F.expr("substring(text, 1, cut)").alias("tail"), F.col("sketch").alias("next_sketch"), F.col("doc_id").alias("next_id")
    )
    both = keyed.join(parts, F.col("row") == F.col("target")).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - cut)"), F.col("tail")))
    sketch, following = F.col("sketch"), F.col("next_sketch")
    both = both.select(
        "doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"),
        "sketch", likeness(sketch, following).alias("near_next"), "next_id",
    )
    return with_sketch(both, "edited", "edited_sketch").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(sketch).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(sketch, F.col("edited_sketch")).alias("near_edited"), "near_next", "next_id",
    )
