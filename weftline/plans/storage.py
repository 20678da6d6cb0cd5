"""Queries through files, stores, outside services and streams: what is written must come back as its rule says."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from weftline.functions import text as T
from weftline.operators import external, queue
from weftline.operators import validate as V
from weftline.sources import jsonl, state
from weftline.sources.evidence import EvidenceTable
from weftline.sources.shared import durable, folder
from weftline.sources.tables import table
from weftline.streaming import exams, live, messages, meter

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TURN = "conv_id long, turn long, role string, text string"


def _written(spark, sf_dir, name="conversations"):
    """The table as JSON Lines in a folder of its own."""
    path = folder(spark, "lines")
    jsonl.write(table(spark, sf_dir, name), path)
    return path


@query("SELECT * FROM conversations")
def jsonl_strict(spark, sf_dir):
    return jsonl.read_strict(spark, _written(spark, sf_dir), _TURN)


#: Lines of which some are cut off; what is no whole JSON object is bad.
_CUT = "l AS (SELECT event_id, CASE WHEN value * 1000 % 3 < 1 THEN substr(line, 1, length(line) - 1) ELSE line END AS line FROM (SELECT *, '{\"event_id\":' || event_id || ',\"props\":' || props || '}' AS line FROM events))"


def _cut(spark, sf_dir):
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    cut = F.when(F.col("value") * 1000 % 3 < 1, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    path = folder(spark, "cut")
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    return path


@query(f"WITH {_CUT} SELECT json_valid(line) AS good, CASE WHEN json_valid(line) THEN event_id END AS event_id, CASE WHEN json_valid(line) THEN (line->'$.props.k')::BIGINT END AS k, CASE WHEN NOT json_valid(line) THEN line END AS line FROM l")
def jsonl_lenient(spark, sf_dir):
    good, bad = jsonl.read_lenient(spark, _cut(spark, sf_dir), "event_id long, props struct<k:long>")
    none = F.lit(None)
    good = good.select(F.lit(True).alias("good"), "event_id", F.col("props.k").alias("k"), none.cast("string").alias("line"))
    return good.unionByName(bad.select(F.lit(False).alias("good"), none.cast("long").alias("event_id"), none.cast("long").alias("k"), F.col("value").alias("line")))


@query("SELECT DISTINCT user_id || '_' || event_type AS _key FROM events WHERE event_id % 5 <> 0 AND value >= 10")
def jsonl_keys(spark, sf_dir):
    key = F.concat_ws("_", F.col("user_id").cast("string"), "event_type")
    # no key, or a line that is cut off
    line = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(key.alias("key")))).otherwise(F.to_json(F.struct(key.alias("_key"))))
    path = folder(spark, "keys")
    table(spark, sf_dir, "events").select(F.when(F.col("value") < 10, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return jsonl.read_keys(spark, path)


@query("""SELECT o_orderkey, o_orderkey % 16 AS src_idx, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) AS line_no, sha1('{"o_orderkey":' || o_orderkey || '}') AS msg_hash FROM orders""")
def jsonl_ordered(spark, sf_dir):
    path = folder(spark, "ordered")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("part"), "o_orderkey")
    lines = rows.repartition(16, "part").sortWithinPartitions("part", "o_orderkey").select("part", F.to_json(F.struct("o_orderkey")).alias("value"))
    lines.write.partitionBy("part").text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=*/part-*")
    found = [str(f.getPath()) for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)]
    found.sort(key=lambda p: int(p.split("/part=")[1].split("/")[0]))
    return jsonl.read_ordered(spark, found, "o_orderkey long").select("o_orderkey", F.col("src_idx").cast("long").alias("src_idx"), "line_no", "msg_hash")


@query("SELECT p_partkey, p_name, origin FROM part, (SELECT unnest(['lines', 'array']) AS origin)")
def jsonl_dual_sink(spark, sf_dir):
    path = folder(spark, "both")
    jsonl.write_both(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path)
    lines = jsonl.read_strict(spark, f"{path}/lines", "p_partkey long, p_name string").withColumn("origin", F.lit("lines"))
    return lines.unionByName(jsonl.read_array(spark, f"{path}/array", "p_partkey long, p_name string").drop("qi").withColumn("origin", F.lit("array")))


@query("SELECT doc_id, CASE WHEN crc % 10 < 8 THEN 'train' ELSE 'validation' END AS split FROM (SELECT doc_id, length(text) AS crc FROM documents)")
def json_splits(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), folder(spark, "splits")
    jsonl.write(docs.where("n % 10 < 8").select("doc_id"), f"{path}/train")
    jsonl.write(docs.where("n % 10 >= 8").select("doc_id"), f"{path}/validation")
    found = jsonl.read_splits(spark, "doc_id long", train=f"{path}/train", validation=f"{path}/validation")
    return found["train"].withColumn("split", F.lit("train")).unionByName(found["validation"].withColumn("split", F.lit("validation")))


@query("SELECT event_id, event_type, n FROM events, (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR event_type = 'error'")
def jsonl_append(spark, sf_dir):
    rows, path = table(spark, sf_dir, "events").select("event_id", "event_type"), folder(spark, "append")
    jsonl.write(rows.withColumn("n", F.lit(1)), path)
    jsonl.write(rows.where("event_type = 'error'").withColumn("n", F.lit(2)), path, append=True)
    return jsonl.read_strict(spark, path, "event_id long, event_type string, n int")


_VERDICT = "CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'review' ELSE 'fail' END"


@query(f"SELECT doc_id, {_VERDICT} AS verdict, place FROM labels, (SELECT unnest(['all', 'own']) AS place)")
def verdict_fanout(spark, sf_dir):
    path = folder(spark, "verdicts")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "review").otherwise("fail")
    jsonl.write_by(table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict")), path)
    every = spark.read.schema("doc_id long, verdict string").json(f"{path}/all").withColumn("place", F.lit("all"))
    # what a folder holds says the verdict too
    own = spark.read.schema("doc_id long, verdict string, by_verdict string").json(f"{path}/by_verdict")
    return every.unionByName(own.where("verdict = by_verdict").drop("by_verdict").withColumn("place", F.lit("own")))


@query("SELECT '{\"events\":' || count(*) || ',\"last\":' || max(event_id) || '}' AS payload FROM events WHERE event_type <> 'error'")
def kv_snapshot(spark, sf_dir):
    store = state.EvidenceStore(spark, folder(spark, "snapshot"))
    events = table(spark, sf_dir, "events")
    for version, rows in enumerate((events, events.where("event_type = 'error'"), events.where("event_type <> 'error'"))):
        store.save_snapshot(rows.select(F.to_json(F.struct(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last")))).first()[0], version)
    return store.snapshot()


#: Events as evidence: every id comes again, and the last version counts.
_LOG = """v AS (SELECT (event_id % 997)::VARCHAR AS event_id, ts, event_type, event_id AS seq FROM events),
    w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS k FROM v)"""


def _log(spark, sf_dir, compact=True):
    eid = F.col("event_id")
    image = F.when(F.col("event_type") != "error", F.encode(F.concat(F.lit("image-"), eid.cast("string")), "utf-8"))
    rows = table(spark, sf_dir, "events").select(
        (eid % 997).cast("string").alias("event_id"), F.col("ts").alias("created_at"), F.to_json(F.struct("event_type")).alias("metadata"), image.alias("image"),
        F.when(image.isNotNull(), "image/png").otherwise("text/plain").alias("mime_type"), eid.alias("ingest_seq"),
    )
    log = EvidenceTable(spark, folder(spark, "evidence"), 16)
    for part in range(3):
        log.append(rows.where(F.col("ingest_seq") % 3 == part), f"part-{part}")
        if part == 1 and compact:
            log.compact()
    return log


@query(f"WITH {_LOG} SELECT event_id, ts AS created_at, event_type AS kind FROM w WHERE k = 1")
def evidence_log(spark, sf_dir):
    return _log(spark, sf_dir).rows().select("event_id", "created_at", F.get_json_object("metadata", "$.event_type").alias("kind"))


@query(f"WITH {_LOG} SELECT event_id, CASE WHEN event_type <> 'error' THEN 'image-' || seq END AS image FROM w WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 200")
def evidence_images(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.with_images(log.history()).select("event_id", F.decode("image", "utf-8").alias("image"))


@query(f"WITH {_LOG} SELECT event_id, 'image-' || seq AS image FROM w WHERE k = 1 AND event_id = '42' AND event_type <> 'error'")
def evidence_image_lookup(spark, sf_dir):
    return _log(spark, sf_dir).image("42").select("event_id", F.decode("image", "utf-8").alias("image"))


@query("SELECT doc_id::VARCHAR AS question, upper(lang) AS profile FROM documents WHERE lang IS NOT NULL")
def key_parse_strict(spark, sf_dir):
    key = F.concat(F.repeat(F.lit("_"), (F.col("doc_id") % 3).cast("int")), F.col("doc_id").cast("string"), F.lit("_"), F.upper("lang"))
    question, profile = T.key_parts_or_fail(F.col("k"))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(key.alias("k")).select(question.alias("question"), profile.alias("profile"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> '' AND text <> ''")
def rows_fail_fast(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    reasons = F.array_compact(F.array(F.when(F.col("role") == "", "no_role"), F.when(F.col("text") == "", "no_text")))
    return V.assert_none(turns.withColumn("reasons", reasons), key="conv_id").select("conv_id", "turn")


# ── outside services, here functions of the text ──


def _shout(prompt: str) -> str:
    if "the" in prompt:
        raise external.Retryable("busy")
    return f"{len(prompt)}:{prompt[:5]}"


@query("SELECT doc_id, CASE WHEN NOT contains(text, 'the') THEN length(text) || ':' || substr(text, 1, 5) END AS reply, CASE WHEN contains(text, 'the') THEN 'busy' END AS error, CASE WHEN contains(text, 'the') THEN 2 ELSE 1 END AS attempts FROM documents")
def chat_calls(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_key"), F.col("text").alias("prompt"))
    return external.call(requests, _shout, retries=1, base=0.0).select(F.col("_key").alias("doc_id"), "reply", "error", "attempts")


@query("SELECT conv_id, turn, 'You are ' || role || '. Answer {ref}: ' || substr(text, 1, 800) || ' [' || substr(text, 1, 40) || ']' AS prompt FROM conversations")
def prompt_texts(spark, sf_dir):
    made = external.prompt("You are {role}. Answer {ref}: {reference} [{short}]", {"short": 40}, role=F.col("role"), reference=F.col("text"), short=F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("prompt"))


@query("SELECT doc_id, 3 * 2 AS n_messages, 'Q' || length(text) || '-5' AS last FROM documents")
def simulated_dialogues(spark, sf_dir):
    candidates = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_key"), F.col("text").alias("source_question"))
    agent = lambda question, said: f"Q{len(question)}-{len(said)}"
    talks = external.simulate(candidates, agent, agent, 3)
    return talks.select(F.col("_key").alias("doc_id"), F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last"))


def _moody(prompt: str) -> str:
    if len(prompt) % 7 == 3:
        raise external.Retryable("always")
    return str(len(prompt))


_OUTCOME = "CASE WHEN length(text) % 7 = 3 THEN 'max_retry' ELSE 'done' END"


@query(f"SELECT source AS _key, length(text) AS n, {_OUTCOME} AS stage, count(*) AS rows FROM documents GROUP BY ALL")
def request_queue(spark, sf_dir):
    now = [0.0]
    jobs = queue.RequestQueue(spark, folder(spark, "queue"), (120.0,), clock=lambda: now[0])
    jobs.add(table(spark, sf_dir, "documents").select(F.col("source").alias("_key"), F.col("text").alias("prompt")))
    while (wait := jobs.run_due(_moody, retries=0)) is not None:
        now[0] += wait
    # the error's history has an entry for each round
    n = F.when(F.col("stage") == "done", F.col("reply").cast("long"))
    found = jobs.results().where("stage = 'done' OR size(error_history) = 2")
    requests = table(spark, sf_dir, "documents").select(F.col("source").alias("_key"), F.length("text").cast("long").alias("n")).where("n % 7 = 3")
    failed = found.where("stage = 'max_retry'").groupBy("_key", "stage").agg(F.count(F.lit(1)).alias("total"))
    lengths = requests.groupBy("_key", "n").agg(F.count(F.lit(1)).alias("rows"))
    wanted = requests.groupBy("_key").agg(F.count(F.lit(1)).alias("asked"))
    same = failed.join(wanted, "_key").where("total = asked").join(lengths, "_key").select("_key", "n", "stage", "rows")
    return found.where("stage = 'done'").groupBy("_key", n.alias("n"), "stage").agg(F.count(F.lit(1)).alias("rows")).unionByName(same)


@query("SELECT page_id, contains(html, 'spam') AS suspicious, CASE WHEN contains(html, 'spam') THEN 'ŞÜPHELİ' ELSE 'TEMİZ' END AS verdict, length(html)::VARCHAR || CASE WHEN page_id % 2 = 0 THEN ' coding' ELSE '' END AS reason FROM pages")
def screen_analysis(spark, sf_dir):
    html = F.concat(F.lit("data:image/png;base64,"), "html")
    screens = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("event_id"), html.alias("screenshot"), F.when(F.col("page_id") % 2 == 0, "coding").otherwise("web").alias("mode"),
        F.lit(None).cast("string").alias("active_process"), F.lit(None).cast("string").alias("window_title"),
    )

    def look(image, note):
        return f"KARAR: {'ŞÜPHELİ' if 'spam' in image else 'TEMİZ'}\nGEREKÇE: {len(image)}{' coding' if 'kodlama' in note else ''}"

    return external.analysed(screens, look, turn=None).select(F.col("event_id").alias("page_id"), "suspicious", "verdict", "reason")


@query("SELECT count(*) AS rows, 0.5 AS share FROM lineitem")
def batch_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    m = meter.BatchMeter(spark)
    n = m.counted(rows).count()
    said = m.read(2 * n)
    return spark.createDataFrame([(said["rows"], said["share"])], "rows long, share double")


# ── streams over the tables, run to their end ──

#: A row beyond all times moves the watermark past everything.
_END = "timestamp '2100-01-01 00:00:00'"


def _streamed(spark, rows, build, mode="append"):
    """What an operator makes of the rows as a stream: they come in two files, the second one after the first."""
    path, out = folder(spark, "stream"), folder(spark, "out")
    half = F.col("ts") <= F.lit(rows.agg(F.percentile_approx("ts", F.lit(0.5), F.lit(100))).first()[0])
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", exams.ROCKS)
    try:
        for part in (rows.where(half), rows.where(~half)):
            part.write.mode("append").parquet(path)
            stream = build(spark.readStream.schema(rows.schema).parquet(path))
            sink = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
            query_ = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
            query_.awaitTermination()
            schema = stream.schema
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(schema.add("batch", IntegerType())).option("recursiveFileLookup", "true").parquet(f"{out}/n=*")


_COMMANDS = """cm AS (SELECT ts, user_id % 5 AS room, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'stop' END AS action, 'x' || event_id AS exam_id, (30 + event_id % 600) AS minutes, lpad(event_id::VARCHAR, 12, '0') AS event_id FROM events WHERE event_type IN ('signup', 'error')),
    nx AS (SELECT *, lead(ts) OVER (PARTITION BY room ORDER BY ts, event_id) AS following FROM cm)"""


@query(f"WITH {_COMMANDS} SELECT room::VARCHAR AS room, exam_id, ts AS started_at, least(ts + to_minutes(minutes::INT), coalesce(following, ts + to_minutes(minutes::INT))) AS ended_at FROM nx WHERE action = 'start'")
def live_exam_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    rows = e.select(
        (F.col("user_id") % 5).cast("string").alias("room"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.when(F.col("event_type") == "signup", "start").otherwise("stop").alias("action"),
        F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("exam_id"), (30 + F.col("event_id") % 600).cast("double").alias("minutes"), F.lit(None).cast("string").alias("student_id"), F.lit(None).cast("string").alias("code"),
    )
    last = rows.limit(1).select(F.lit("end").alias("room"), F.expr(_END).alias("ts"), F.lit("end").alias("event_id"), F.lit("none").alias("action"), *rows.columns[4:])
    got = durable(_streamed(spark, rows.unionByName(last), exams.rooms))
    begun = got.where("kind = 'started'").select("room", "exam_id", F.col("at").alias("started_at"))
    return begun.join(got.where("kind = 'ended'").select("room", "exam_id", F.col("at").alias("ended_at")), ["room", "exam_id"])


@query("SELECT user_id % 3 AS exam_id, date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS alerts FROM events GROUP BY ALL")
def live_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").cast("string").alias("event_id"), (F.col("user_id") % 3).alias("exam_id"), F.col("user_id").alias("student_id"), F.col("event_type").alias("reason"), "ts",
        F.when(F.col("event_type") == "error", "suspicious").otherwise("clean").alias("status"), F.lit(None).cast("boolean").alias("suspicious"),
    )
    # a seventh of the events comes twice
    got = _streamed(spark, rows.unionByName(rows.where("event_id % 7 = 0")), lambda s: exams.counters(s, late="60 days"), "update")
    return got.groupBy("exam_id", "day").agg(F.max_by(F.struct("total", "alerts"), "batch").alias("c")).select("exam_id", "day", "c.*")


_FOCUS = "f AS (SELECT user_id AS student_id, ts, event_id, event_type <> 'click' AS focused FROM events), c AS (SELECT *, lag(focused) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS before FROM f), d AS (SELECT *, lead(ts) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS until FROM c WHERE before IS NULL OR before <> focused)"


@query(f"WITH {_FOCUS} SELECT student_id::VARCHAR AS student_id, ts AS since FROM d WHERE NOT focused AND (until IS NULL OR until >= ts + INTERVAL 3 SECONDS)")
def live_focus(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("student_id"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), (F.col("event_type") != "click").alias("focused"))
    last = rows.limit(1).select(F.lit("end").alias("student_id"), F.expr(_END).alias("ts"), F.lit("end").alias("event_id"), F.lit(True).alias("focused"))
    got = _streamed(spark, rows.unionByName(last), lambda s: exams.unfocus_episodes(s, idle=10 * 365 * 86400))
    return got.where("kind = 'open'").select("student_id", "since")


_TYPED = """m AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'join' WHEN 'error' THEN 'dance' WHEN 'click' THEN 'focus' ELSE 'alert' END AS type, value FROM events)"""


@query(f"WITH {_TYPED} SELECT event_id AS place, CASE WHEN type = 'dance' THEN 'unknown_type' WHEN type = 'focus' AND value < 50 THEN 'missing_focused' END AS reason, type, ts FROM m")
def message_types(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "view", "heartbeat").when(kind == "signup", "join").when(kind == "error", "dance").when(kind == "click", "focus").otherwise("alert")
    focused = F.when((name == "focus") & (F.col("value") >= 50), F.lit(True))
    token = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    line = F.to_json(F.struct(name.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), token.alias("token"), focused.alias("focused")))
    lines = table(spark, sf_dir, "events").select(F.lit("log").alias("file"), F.col("event_id").alias("position"), line.alias("value"))
    good = [messages.of_type(lines, t).select(F.col("position").alias("place"), F.lit(None).cast("string").alias("reason"), F.lit(t).alias("type"), "ts") for t in ("heartbeat", "join", "focus", "alert")]
    claimed = F.get_json_object("value", "$.type").alias("type")
    bad = messages.bad(lines).select(F.col("position").alias("place"), "reason", claimed, F.to_timestamp(F.get_json_object("value", "$.ts")).alias("ts"))
    out = bad
    for part in good:
        out = out.unionByName(part)
    return out


@query("SELECT DISTINCT route FROM (SELECT unnest(['require_vlm', 'direct_alert']) AS route) WHERE (SELECT count(*) FROM events) > 0")
def received_routes(spark, sf_dir):
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("student_id"), F.col("ts"), F.when(F.col("event_type") == "click", "tab_switch").otherwise("periodic").alias("reason"), F.lit("web").alias("mode")))
    events, _ = live.received(table(spark, sf_dir, "events").select(line.alias("value")))
    return live.routed(events).select("route").distinct()
