"""What the training-data operators share: tables, shared storage, small joins, numbering."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points that separate words in every contract of this subpackage.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A column name of our own, for tables whose columns we do not know.
ROW = "__weftline_row"

#: Rows up to which a per-key table may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session may go without; it then gets a folder of its own. A cluster without the
    setting is refused, since a machine-local folder would be invisible to the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


#: Paths that `stored` wrote, in the innermost block of `stored_alone` last. Each thread has its own: what one query
#: writes is no business of another that runs beside it.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())

_lock = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


@contextmanager
def _eager_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a query ends, while any thread of the session writes; the setting of before comes back after the last."""
    own = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writers.get(own, (0, ""))
        if not n:
            before = spark.conf.get(_CLEAN_UP, "false")
            spark.conf.set(_CLEAN_UP, "true")
        _writers[own] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(own)
            if n > 1:
                _writers[own] = (n - 1, before)
            else:
                spark.conf.set(_CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: what reads the result survives the loss of any executor, and work that
    several consumers need runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    # The result is written: its shuffle files may go at once. A query that runs beside this write and
    # sees the setting only loses shuffle files that it might have used a second time.
    with _eager_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    if held := _written.get():
        held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_parts(spark: SparkSession, parts: int, build: Callable[[int], DataFrame], name: str) -> DataFrame:
    """One stored table of what `build` gives for each number below `parts`, one after another.

    What a part shuffles, and the tables stored while it is built, go before the next part begins.
    """
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    if held := _written.get():
        held[-1].append(path)
    for i in range(parts):
        with cleared(spark):
            df = build(i)
            with _eager_cleanup(spark):
                df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Removes, at the end of the block, the tables stored in it under other names than `kept`."""
    outer = _written.get()
    made: list[str] = []
    token = _written.set((*outer, made))
    try:
        yield
    finally:
        _written.reset(token)
        stay = [path for path in made if path.rsplit("/", 1)[1].rpartition("-")[0] in kept]
        removed(spark, [path for path in made if path not in stay])
        if outer:
            outer[-1].extend(stay)


def stored_alone(build: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The stored result of `build` and its path. Whatever else was stored on the way is removed."""
    made: list[str] = []
    token = _written.set((*_written.get(), made))
    try:
        done = stored(build(), name)
    finally:
        _written.reset(token)
    *others, path = made
    removed(done.sparkSession, others)
    return done, path


def join_small(df: DataFrame, small: DataFrame, on: Column, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a per-key table: broadcast if it has been counted and is small, shuffled otherwise.

    `small` should be stored or otherwise cheap to count.
    """
    if len(small.take(limit + 1)) <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)


#: Keys that hold more than this share of the rows, or LEAST_HEAVY rows if that is more, are heavy.
HEAVY_SHARE = 1 / 5000
LEAST_HEAVY = 1000


def join_split(df: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of `df` with a stored table of one row per key, whose column `weight` says how many rows of `df` have the key.

    Heavy keys, fewer than 1 / HEAVY_SHARE of them whatever the data, are broadcast, so that no key's rows
    meet in one task; all other keys are joined by shuffling.
    """
    total, most = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(LEAST_HEAVY, int(total * HEAVY_SHARE))
    if most <= limit:
        return df.join(keyed, on)
    heavy = keyed.where(F.col(weight) > limit)
    hot = df.join(F.broadcast(heavy), on)
    rest = df.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keyed.where(F.col(weight) <= limit), on)
    return hot.unionByName(rest)


def anti_split(df: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """The rows of `df` without a row in `keyed`, which is as for `join_split`: heavy keys' rows are dropped where they are read."""
    total, most = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(LEAST_HEAVY, int(total * HEAVY_SHARE))
    if most > limit:
        df = df.join(F.broadcast(keyed.where(F.col(weight) > limit).select(*on)), on, "left_anti")
    return df.join(keyed.where(F.col(weight) <= limit).select(*on), on, "left_anti")


def join_salted(df: DataFrame, keyed: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join of a stored `df` with a table of one row per key whose rows may be large, such as texts.

    A heavy key's rows are dealt by a hash of the column `by` over as many copies of the key's row as their
    number asks for; only the heavy keys' numbers, fewer than 1 / HEAVY_SHARE rows, are broadcast.
    """
    sizes = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(LEAST_HEAVY, int(total * HEAVY_SHARE))
    if most <= limit:
        return df.join(keyed, on)
    heavy = F.broadcast(sizes.where(F.col("_n") > limit).select(on, F.ceil(F.col("_n") / limit).cast("int").alias("_fan")))
    fan, salt = F.coalesce("_fan", F.lit(1)), f"{ROW}_salt"
    dealt = df.join(heavy, on, "left").withColumn(salt, F.pmod(F.xxhash64(by), fan).cast("int")).drop("_fan")
    copies = keyed.join(heavy, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return dealt.join(copies, [on, salt]).drop(salt)


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of `df` whose `column`, numbered by monotonically_increasing_id, occurs in `ids`, without a shuffle of `df`.

    What is broadcast is a bitmap: a bit for each number that `df` may have, and at least 4 KB for each partition that was numbered.
    """
    at, bits, bucket = F.col(column) + 1, f"{ROW}_bits", f"{ROW}_bucket"
    marks = ids.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2
    met = df.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col(bucket)).where(bit == 1)
    return met.select(*(F.col(f"`{c}`") for c in df.columns))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def numbered(df: DataFrame, group: list[str], fine: list[str], order: list[Column], out: str) -> DataFrame:
    """Gapless numbers from 0 within each `group`, without one task per group.

    Rows are numbered inside each (group, fine) cell; cells get offsets from their counts. `fine`
    columns must cut a group into evenly sized cells of a bounded number per group.
    """
    cell = Window.partitionBy(*group, *fine).orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(cell).cast("long"))
    counts = df.groupBy(*group, *fine).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, *fine, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        df.join(starts, [*group, *fine])
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .drop("_rn", "_start")
    )


def most_frequent(counts: DataFrame, at_least: int, most: int) -> DataFrame:
    """The rows of stored `counts` with n >= at_least, or with a higher limit that at most `most` rows reach.

    The limit comes from a histogram of n, so that no ranking passes through one place.
    """
    sizes = counts.where(F.col("n") >= at_least).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    upto = sizes.withColumn("upto", F.sum("rows").over(Window.orderBy(F.desc("n"))))
    limit = upto.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= limit) if limit is not None else counts.where(F.lit(False))
