"""JSON Lines and JSON array files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.utils import AnalysisException

from weftline.functions import messages as M
from weftline.sources.shared import durable

MESSAGES = "array<struct<role:string,content:string>>"
#: The fields of a dialogue record that operators read.
DIALOGUE = (
    "_key string, _type string, _qi long, profile string, topic string, source_question string, system string, "
    f"messages {MESSAGES}, judge struct<verdict:string>, qc_flags struct<tutor_retry_count:int>"
)
_BAD = "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: str = DIALOGUE) -> DataFrame:
    """Records of JSON Lines files; a bad line ends the query with an error. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str = DIALOGUE) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines); a path without files gives empty frames."""
    wide = StructType.fromDDL(f"{schema}, {_BAD} string")
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    read = lines.where(F.btrim("value") != "").select(F.from_json("value", wide, options).alias("r"), "value")
    bad = F.col(f"r.{_BAD}").isNotNull()
    return read.where(~bad).select("r.*").drop(_BAD), read.where(bad).select("value")


def read_keys(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct _key values of all files; anything unreadable is passed over, a byte order mark is ignored."""
    try:
        lines = spark.read.text(list(paths))
    except AnalysisException:
        return spark.createDataFrame([], "_key string")
    key = F.get_json_object(F.regexp_replace("value", "^\\ufeff", ""), "$._key")
    return lines.select(key.alias("_key")).where("_key IS NOT NULL").distinct()


#: Blocks of files whose starts are broadcast to their lines; more are joined by shuffling.
BROADCAST_BLOCKS = 500_000


def _plain(path: Column) -> Column:
    """A file's address with one slash after its scheme where there is no host, as different parts of Spark write it."""
    return F.regexp_replace(path, "^([a-z0-9+.-]+):/(?://)?(?=[^/])", "$1:/")


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value, place (the file's address), line_no (from 1, blank lines counted) of the lines of all files, read by one scan.

    A line's number is that of its file's blocks before its own, and its place in the block: only one row for
    each block is ordered, by file, and the lines stay where they are read.
    """
    lines = spark.read.text(paths).select(
        "value", _plain(F.col("_metadata.file_path")).alias("place"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    blocks = lines.groupBy("place", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = durable(blocks.select("place", "block", (before - F.col("first") + 1).alias("shift")))
    if starts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["place", "block"]).select("value", "place", (F.col("at") + F.col("shift")).alias("line_no"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no (from 1, blank lines counted) of the lines of one text file."""
    return _numbered(spark, [path]).select("value", "line_no")


def read_ordered(spark: SparkSession, paths: list[str], schema: str = DIALOGUE) -> DataFrame:
    """Records with src_path, src_idx (place of the file in `paths`), line_no (from 1, blank lines counted) and msg_hash.

    msg_hash is the hash of the messages' contents, null without messages; of records without such a field, of the line.
    All files are one scan, however many there are; a path that is named twice gives its records twice.
    """
    if not paths:
        raise ValueError("no input files")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def address(path: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf).makeQualified(place).toUri().toString()

    known = spark.createDataFrame([(i, p, address(p)) for i, p in enumerate(paths)], "src_idx int, src_path string, _place string")
    named = F.broadcast(known.withColumn("_place", _plain(F.col("_place"))))
    found = _numbered(spark, list(dict.fromkeys(paths))).join(named, F.col("place") == F.col("_place")).drop("place", "_place")
    parsed = found.where(F.btrim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    has_messages = "messages" in parsed.schema["r"].dataType.fieldNames()
    msg_hash = M.content_hash(F.col("r.messages")) if has_messages else F.sha1("value")
    return parsed.select("r.*", "src_path", "src_idx", "line_no", msg_hash.alias("msg_hash"))


def read_array(spark: SparkSession, path: str, item: str, first: int = 0, most: int | None = None) -> DataFrame:
    """Items of one JSON array with their place `qi`; from `first`, at most `most` of them."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", ArrayType(StructType.fromDDL(item)), {"mode": "FAILFAST"})).alias("qi", "x"))
    some = items.where(F.col("qi") >= first)
    if most is not None:
        some = some.where(F.col("qi") < first + most)
    return some.select("qi", "x.*")


def read_splits(spark: SparkSession, schema: str = f"messages {MESSAGES}", **paths: str) -> dict[str, DataFrame]:
    """Named splits, each read strictly."""
    return {name: read_strict(spark, path, schema) for name, path in paths.items()}


def write(rows: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; fields that are null are written as null."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").option("compression", "none").json(path)


def write_both(rows: DataFrame, path: str) -> None:
    """JSON Lines under lines/, and array/ whose every file is a JSON array of its partition's records."""
    write(rows, f"{path}/lines")

    def arrays(batches):
        mark = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_pydict({"value": [mark + values[0], *("," + v for v in values[1:])]})
                mark = ","
        yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})

    objects = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    objects.mapInArrow(arrays, "value string").write.mode("overwrite").text(f"{path}/array")


def write_by(rows: DataFrame, path: str, column: str = "verdict") -> None:
    """all/ with every record, and a folder for each value of `column`."""
    write(rows, f"{path}/all")
    rows.withColumn(f"by_{column}", F.col(column)).write.mode("overwrite").partitionBy(f"by_{column}").json(f"{path}/by_{column}")


def append_batches(path: str):
    """A function for `writeStream.foreachBatch` that appends each batch once: a batch has a folder of its own."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return sink
