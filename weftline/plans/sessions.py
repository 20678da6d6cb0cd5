"""Queries on the events of monitored sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import sessions as S
from weftline.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Session events made of the events table.
_E = """e AS (SELECT event_id, ts, user_id AS student_id, user_id % 3 AS exam_id,
    CASE event_type WHEN 'view' THEN 'periodic' WHEN 'click' THEN 'tab_switch' WHEN 'error' THEN 'window_unfocused' WHEN 'purchase' THEN 'desktop_periodic' ELSE 'manual' END AS reason,
    CASE WHEN user_id % 2 = 0 THEN 'coding' ELSE 'web' END AS mode,
    'https://' || ['docs.python.org', 'ChatGPT.com/x', 'stackoverflow.com/q', 'example.org'][(event_id % 4 + 1)::INT] AS tab_url,
    ['Code.exe', 'game.exe', ''][(event_id % 3 + 1)::INT] AS active_process, value FROM events)"""


def _events(spark, sf_dir):
    e, eid = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    reason = F.when(kind == "view", "periodic").when(kind == "click", "tab_switch").when(kind == "error", "window_unfocused").when(kind == "purchase", "desktop_periodic").otherwise("manual")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (eid % n).cast("int"))
    return e.select(
        "event_id", "ts", F.col("user_id").alias("student_id"), (F.col("user_id") % 3).alias("exam_id"), reason.alias("reason"),
        F.when(F.col("user_id") % 2 == 0, "coding").otherwise("web").alias("mode"),
        F.concat(F.lit("https://"), pick(("docs.python.org", "ChatGPT.com/x", "stackoverflow.com/q", "example.org"), 4)).alias("tab_url"),
        pick(("Code.exe", "game.exe", ""), 3).alias("active_process"), "value",
    )


def _routed(spark, sf_dir):
    return S.routed(_events(spark, sf_dir).withColumns({"tab_title": F.lit(None).cast("string"), "window_title": F.lit("")}))


_ROUTED = _E + """, r AS (SELECT *, CASE WHEN reason = 'tab_switch' THEN 1 WHEN mode = 'coding' AND event_id % 4 = 1 THEN 2 WHEN mode = 'coding' AND event_id % 4 = 2 THEN 3 WHEN mode = 'coding' AND event_id % 3 = 1 THEN 4
        WHEN mode = 'coding' AND reason IN ('periodic', 'desktop_periodic', 'window_unfocused') THEN 5 WHEN mode = 'coding' THEN 6 WHEN reason IN ('periodic', 'desktop_periodic', 'window_unfocused') THEN 7 ELSE 8 END AS c FROM e),
    ro AS (SELECT *, CASE WHEN c IN (1, 2) THEN 'direct_alert' WHEN c = 6 THEN 'direct_clean' ELSE 'require_vlm' END AS route, CASE WHEN c IN (1, 2) THEN 'high' WHEN c IN (3, 4, 7) THEN 'medium' ELSE 'low' END AS risk,
        CASE c WHEN 2 THEN 'chatgpt' WHEN 3 THEN 'stackoverflow' WHEN 4 THEN 'game.exe' END AS hit FROM r)"""


@query(f"WITH {_ROUTED} SELECT event_id, route, risk, hit FROM ro")
def event_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select("event_id", "route", "risk", "hit")


@query(f"WITH {_ROUTED} SELECT mode, route, risk, count(*) AS n FROM ro GROUP BY mode, route, risk")
def coding_risk(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("mode", "route", "risk").agg(F.count(F.lit(1)).alias("n"))


_VOTES = _E + """, v AS (SELECT *, value > 40 AS suspicious, CASE WHEN event_id % 11 = 0 THEN 'HATA' WHEN value > 40 THEN 'ŞÜPHELİ' ELSE 'TEMİZ' END AS verdict, mode = 'coding' AND reason IN ('periodic', 'desktop_periodic') AS votes FROM e),
    w AS (SELECT *, count(*) OVER l AS n, sum(suspicious::INT) OVER l AS bad FROM v WINDOW l AS (PARTITION BY exam_id, student_id, votes ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, suspicious AND (NOT votes OR (n >= 3 AND bad >= 2)) AS confirmed FROM w),
    sm AS (SELECT *, CASE WHEN verdict = 'HATA' OR (suspicious AND NOT confirmed) THEN 'uncertain' WHEN confirmed THEN 'suspicious' ELSE 'clean' END AS status,
        CASE WHEN verdict = 'HATA' THEN 'HATA' WHEN suspicious AND NOT confirmed THEN 'BELİRSİZ' ELSE verdict END AS verdict_out, CASE WHEN confirmed AND verdict <> 'HATA' THEN 'alert' ELSE 'screenshot' END AS channel FROM c)"""


def _smoothed(spark, sf_dir):
    bad = F.col("value") > 40
    results = _events(spark, sf_dir).withColumns({"suspicious": bad, "verdict": F.when(F.col("event_id") % 11 == 0, "HATA").when(bad, "ŞÜPHELİ").otherwise("TEMİZ")})
    return S.smoothed(results)


@query(f"WITH {_VOTES} SELECT event_id, confirmed, status, verdict_out, channel, status <> 'clean' AS kept FROM sm")
def vote_smoothing(spark, sf_dir):
    return _smoothed(spark, sf_dir).select("event_id", "confirmed", "status", "verdict_out", "channel", "kept")


@query(f"WITH {_VOTES} SELECT exam_id, student_id, count(*) FILTER (reason = 'tab_switch' OR (status = 'suspicious' AND exam_id = 1) OR event_id % 50 = 0) AS alerts FROM sm GROUP BY exam_id, student_id")
def alert_counts(spark, sf_dir):
    rows = _smoothed(spark, sf_dir)
    return S.alert_counts(rows.withColumns({"route": F.when(F.col("reason") == "tab_switch", "direct_alert").otherwise("require_vlm"), "current_exam": F.lit(1), "kind": F.when(F.col("event_id") % 50 == 0, "client_alert").otherwise("screenshot")}))


@query(f"WITH {_E}, a AS (SELECT exam_id, student_id, count(*) FILTER (reason = 'tab_switch' AND event_id % 9 = 0) AS n FROM e GROUP BY exam_id, student_id) SELECT exam_id, student_id, CASE WHEN n = 0 THEN 'zero' WHEN n <= 2 THEN 'low' ELSE 'high' END AS badge FROM a")
def badge_bands(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("exam_id", "student_id").agg(F.count_if((F.col("reason") == "tab_switch") & (F.col("event_id") % 9 == 0)).alias("n"))
    return rows.select("exam_id", "student_id", S.badge(F.col("n")).alias("badge"))


@query(f"""WITH {_VOTES} SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'pending' WHEN status = 'uncertain' THEN 'uncertain' WHEN event_id % 17 = 0 THEN 'critical'
    WHEN status = 'suspicious' THEN CASE WHEN verdict_out = 'ŞÜPHELİ' THEN 'agent-flag' ELSE 'suspicious' END ELSE 'periodic' END AS card FROM sm""")
def card_classify(spark, sf_dir):
    status = F.when(F.col("event_id") % 13 == 0, "pending").otherwise(F.col("status"))
    kind = F.when(F.col("event_id") % 17 == 0, "ai_extension_detected").otherwise(F.lit(None))
    return _smoothed(spark, sf_dir).select("event_id", S.card(status, kind, F.col("verdict_out"), F.col("channel") == "alert").alias("card"))


@query(f"WITH {_VOTES}, d AS (SELECT event_id // 2 AS id, arg_min(status = 'suspicious' OR suspicious, event_id) AS bad FROM sm GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (bad) AS alerts FROM d")
def dashboard_counters(spark, sf_dir):
    rows = _smoothed(spark, sf_dir).withColumns({"seq": F.col("event_id"), "event_id": F.floor(F.col("event_id") / 2).cast("string")})
    return S.dashboard(rows)


#: Every tenth event arrives twice.
_TWICE = "tw AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 10 = 3)"


def _twice(events):
    return events.unionByName(events.where("event_id % 10 = 3"))


@query(f"""WITH {_E}, {_TWICE}, r AS (SELECT event_id, ts + to_seconds((event_id * 7 % 40)::INT) AS done_at, value > 40 AS suspicious FROM e WHERE event_id % 5 <> 0
        UNION ALL SELECT event_id, ts + to_seconds((event_id % 25)::INT), FALSE FROM e WHERE event_id % 6 = 0),
    j AS (SELECT e.event_id, min(r.done_at) AS done_at FROM e LEFT JOIN r ON r.event_id = e.event_id AND r.done_at >= e.ts AND r.done_at <= e.ts + INTERVAL 20 SECONDS GROUP BY e.event_id)
    SELECT event_id, done_at, done_at IS NULL AS timed_out FROM tw JOIN j USING (event_id)""")
def analysis_timeout(spark, sf_dir):
    e = _events(spark, sf_dir)
    later = lambda n: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))
    first = e.where("event_id % 5 <> 0").select("event_id", later(F.col("event_id") * 7 % 40).alias("done_at"), (F.col("value") > 40).alias("suspicious"))
    second = e.where("event_id % 6 = 0").select("event_id", later(F.col("event_id") % 25).alias("done_at"), F.lit(False).alias("suspicious"))
    return S.timed_out(_twice(e).select("event_id", "ts"), first.unionByName(second)).select("event_id", "done_at", "timed_out")


@query(f"""WITH {_E}, l AS (SELECT student_id, max(ts) AS last_seen, arg_max(CASE WHEN reason = 'manual' THEN 'left' ELSE 'active' END, (ts, event_id)) AS state FROM e GROUP BY student_id)
    SELECT student_id, last_seen, CASE WHEN state = 'active' AND last_seen < (SELECT max(ts) FROM e) - INTERVAL 1 DAY THEN 'idle' ELSE state END AS status FROM l""")
def presence_idle(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("state", F.when(F.col("reason") == "manual", "left").otherwise("active"))
    now = e.agg(F.max("ts")).first()[0]
    return S.presence(e, F.lit(now).cast(e.schema["ts"].dataType), 86400)


#: One attempt after the other, per address, as the rule is stated.
@query(f"""WITH RECURSIVE {_E}, {_TWICE}, a AS (SELECT student_id % 5 AS addr, event_id, epoch_us(ts) / 3e9 AS t, event_id % 37 = 0 AS good, row_number() OVER (PARTITION BY student_id % 5 ORDER BY ts, event_id) AS i FROM tw),
    s AS (SELECT addr, i, event_id, FALSE AS blocked, CASE WHEN good THEN []::DOUBLE[] ELSE [t] END AS held FROM a WHERE i = 1
        UNION ALL SELECT a.addr, a.i, a.event_id, len(list_filter(s.held, lambda x: x >= a.t - 60)) >= 10,
            CASE WHEN len(list_filter(s.held, lambda x: x >= a.t - 60)) >= 10 THEN list_filter(s.held, lambda x: x >= a.t - 60) WHEN a.good THEN []::DOUBLE[] ELSE list_append(list_filter(s.held, lambda x: x >= a.t - 60), a.t) END
        FROM s JOIN a ON a.addr = s.addr AND a.i = s.i + 1)
    SELECT event_id, blocked FROM s""")
def login_throttle(spark, sf_dir):
    # three thousand times faster than the table's clock, so that attempts crowd
    fast = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 3000).cast("long"))
    e = _twice(_events(spark, sf_dir)).select("event_id", fast.alias("ts"), (F.col("student_id") % 5).alias("addr"), (F.col("event_id") % 37 == 0).alias("flag"))
    return S.throttled(e).select("event_id", "blocked")


@query(f"""WITH RECURSIVE {_E}, {_TWICE}, a AS (SELECT student_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY student_id ORDER BY ts, event_id) AS i FROM tw),
    s AS (SELECT student_id, i, event_id, TRUE AS emitted, t AS last FROM a WHERE i = 1
        UNION ALL SELECT a.student_id, a.i, a.event_id, a.t - s.last >= 43200, CASE WHEN a.t - s.last >= 43200 THEN a.t ELSE s.last END FROM s JOIN a ON a.student_id = s.student_id AND a.i = s.i + 1)
    SELECT event_id, emitted FROM s""")
def capture_cooldown(spark, sf_dir):
    return S.cooled_down(_twice(_events(spark, sf_dir)), 43200).select("event_id", "emitted")


@query(f"""WITH {_E}, f AS (SELECT student_id, ts, reason <> 'window_unfocused' AS focused, event_id, lag(reason <> 'window_unfocused') OVER (PARTITION BY student_id ORDER BY ts, event_id) AS b FROM e),
    c AS (SELECT *, lead(ts) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS until FROM f WHERE b IS NULL OR b <> focused)
    SELECT student_id, ts AS since, until FROM c WHERE NOT focused AND (until IS NULL OR until >= ts + INTERVAL 3 SECONDS)""")
def unfocus_episodes(spark, sf_dir):
    return S.unfocus_episodes(_events(spark, sf_dir).select("student_id", "ts", "event_id", (F.col("reason") != "window_unfocused").alias("focused")))


@query(f"WITH {_E}, l AS (SELECT *, lag(tab_url) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS b FROM e) SELECT event_id, student_id AS tab_id, tab_url AS url FROM l WHERE b IS NULL OR b <> tab_url")
def url_dedup(spark, sf_dir):
    visits = _events(spark, sf_dir).select("event_id", "ts", F.col("student_id").alias("tab_id"), F.col("tab_url").alias("url"))
    return S.changed_urls(visits).select("event_id", "tab_id", "url")


@query(f"""WITH {_E}, w AS (SELECT student_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT *, coalesce(date_diff('day', lag(window_start) OVER (PARTITION BY student_id ORDER BY window_start), window_start) - 1, 0) AS silent_before FROM w""")
def report_gaps(spark, sf_dir):
    return S.gaps(_events(spark, sf_dir), 86400)


@query(r"""SELECT page_id, regexp_matches(url, '^https?://') AS capturable, (lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) IN ('https://thther.example.org', 'http://therha.example.com') AND (regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '/en' OR starts_with(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/en/')))
        OR lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) = 'https://therin.example.net' AS allowed FROM pages""")
def url_allowlist(spark, sf_dir):
    allowed = ("https://thther.example.org:443/en/", "HTTP://Therha.example.com/en", "https://therin.example.net")
    return table(spark, sf_dir, "pages").select("page_id", U.is_capturable(F.col("url")).alias("capturable"), U.is_allowed(F.col("url"), allowed).alias("allowed"))


#: Data URLs of images that hold an event's properties after the bytes that mark their kind, some marred as the event's value says.
_SHOTS = """u AS (SELECT event_id, (value * 100)::BIGINT % 6 AS c, base64(from_hex(CASE (value * 100)::BIGINT % 6 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' ELSE '47494638' END) || encode(props)) AS body FROM events),
    d AS (SELECT event_id, CASE c WHEN 3 THEN body WHEN 4 THEN 'data:text/plain;base64,' || body WHEN 5 THEN NULL ELSE 'data:image/x;base64,' || body END AS url FROM u),
    h AS (SELECT event_id, CASE WHEN starts_with(url, 'data:image/') THEN hex(from_base64(split_part(url, ',', 2))) END AS h FROM d),
    m AS (SELECT event_id, CASE WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' END AS mime FROM h)"""


@query(f"WITH {_SHOTS} SELECT event_id, CASE WHEN mime IS NULL THEN 400 ELSE 200 END AS status, mime FROM m")
def screenshot_decode(spark, sf_dir):
    c = (F.round(F.col("value") * 100) % 6).cast("int")
    magic = F.unhex(F.when(c == 0, "FFD8FFE0").when(c == 1, "89504E470D0A1A0A").otherwise("47494638"))
    body = F.base64(F.concat(magic, F.encode("props", "utf-8")))
    data = F.when(c == 3, body).when(c == 4, F.concat(F.lit("data:text/plain;base64,"), body)).when(c == 5, F.lit(None)).otherwise(F.concat(F.lit("data:image/x;base64,"), body))
    status, mime = S.screenshot(F.col("d"))
    return table(spark, sf_dir, "events").select("event_id", data.alias("d")).select("event_id", status.alias("status"), mime.alias("mime"))


_EV = """ev AS (SELECT (event_id % 700)::VARCHAR AS event_id, arg_max(ts, event_id) AS created_at, arg_max(user_id % 4, event_id) AS exam, arg_max(event_type, event_id) AS kind, max(event_id) AS ingest_seq FROM events GROUP BY 1)"""


def _evidence(spark, sf_dir):
    eid = F.col("event_id")
    metadata = F.to_json(F.struct(F.concat(F.lit("exam"), (F.col("user_id") % 4).cast("string")).alias("examId"), F.col("event_type").alias("kind")))
    image = F.when(F.col("event_type") != "error", "image/jpeg").otherwise("application/octet-stream")
    rows = table(spark, sf_dir, "events").select((eid % 700).cast("string").alias("event_id"), F.col("ts").alias("created_at"), metadata.alias("metadata"), F.lit(None).cast("binary").alias("image"), image.alias("mime_type"), eid.alias("ingest_seq"))
    return S.latest_evidence(rows)


@query(f"WITH {_EV} SELECT event_id, created_at, 'exam' || exam AS exam_id FROM ev")
def evidence_upsert(spark, sf_dir):
    return _evidence(spark, sf_dir).select("event_id", "created_at", F.get_json_object("metadata", "$.examId").alias("exam_id"))


@query(f"WITH {_EV} SELECT event_id, created_at FROM ev WHERE exam = 2 ORDER BY created_at DESC, event_id DESC LIMIT 50")
def evidence_topk(spark, sf_dir):
    return S.listed(_evidence(spark, sf_dir), 50, "exam2").select("event_id", "created_at")


@query(f"WITH {_EV} SELECT event_id, created_at, kind FROM ev WHERE event_id = '42'")
def evidence_lookup(spark, sf_dir):
    return _evidence(spark, sf_dir).where("event_id = '42'").select("event_id", "created_at", F.get_json_object("metadata", "$.kind").alias("kind"))


@query(f"WITH {_EV} SELECT event_id, kind <> 'error' AS has_image, CASE WHEN kind <> 'error' THEN event_id END AS evidence_id FROM ev")
def history_items(spark, sf_dir):
    return S.history_items(_evidence(spark, sf_dir)).select("event_id", "has_image", "evidence_id")


_NEWEST = f"""{_VOTES}, n AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') END AS started, row_number() OVER (PARTITION BY exam_id ORDER BY ts DESC, event_id DESC) AS k
    FROM (SELECT * FROM sm ORDER BY ts DESC, event_id DESC LIMIT 1000))"""


def _history(spark, sf_dir):
    return _smoothed(spark, sf_dir).select(
        "event_id", F.col("ts").alias("created_at"), F.when(F.col("exam_id") != 2, F.concat(F.lit("exam"), F.col("exam_id").cast("string"))).alias("exam_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("C"), F.col("event_id").cast("string"))).otherwise("").alias("exam_code"),
        F.when(F.col("event_id") % 4 != 0, F.date_format(F.col("ts") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm")).alias("started_at"), "mode", "status", F.lit(False).alias("suspicious"),
    )


@query(f"""WITH {_NEWEST}
    SELECT 'exam' || exam_id AS exam_id, coalesce(arg_max('C' || event_id, (ts, event_id)) FILTER (event_id % 3 = 0), '') AS exam_code, max(mode) FILTER (k = 1) AS mode, max(ts) AS last_event_at, max(started) FILTER (k = 1) AS started_at,
        count(*) AS event_count, count(*) FILTER (status = 'suspicious') AS suspicious_count FROM n WHERE exam_id <> 2 GROUP BY exam_id""")
def exam_history_rollup(spark, sf_dir):
    return S.exam_history(_history(spark, sf_dir))


@query(f"WITH {_NEWEST} SELECT count(*) FILTER (exam_id = 2) AS legacy_count FROM n")
def exam_history_legacy(spark, sf_dir):
    return S.legacy_count(_history(spark, sf_dir))


_EXAMS = """cm AS (SELECT ts, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'stop' END AS action, 'x' || event_id AS exam_id, (30 + event_id % 600) AS minutes FROM events WHERE event_type IN ('signup', 'error')),
    ex AS (SELECT exam_id, ts AS started_at, least(ts + to_minutes(minutes::INT), coalesce(nx, ts + to_minutes(minutes::INT))) AS ended_at FROM (SELECT *, lead(ts) OVER (ORDER BY ts, exam_id) AS nx FROM cm) WHERE action = 'start')"""


def _exams(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    commands = e.select("ts", F.when(F.col("event_type") == "signup", "start").otherwise("stop").alias("action"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("exam_id"), (30 + F.col("event_id") % 600).cast("int").alias("minutes"))
    return S.exam_intervals(commands)


@query(f"WITH {_EXAMS} SELECT * FROM ex")
def exam_lifecycle(spark, sf_dir):
    return _exams(spark, sf_dir)


@query(f"WITH {_EXAMS} SELECT event_id, x.exam_id, x.started_at AS exam_started_at FROM events LEFT JOIN ex x ON x.started_at <= ts AND ts < x.ended_at")
def exam_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return S.during_exam(events, _exams(spark, sf_dir)).select("event_id", "exam_id", "exam_started_at")


@query(f"WITH {_EXAMS} SELECT exam_id, greatest(floor(epoch(ended_at))::BIGINT - floor(epoch(TIMESTAMP '2024-01-15 00:00:00'))::BIGINT, 0) AS seconds_left FROM ex")
def exam_countdown(spark, sf_dir):
    return S.countdown(_exams(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query("""WITH u AS (SELECT event_id AS use_id, event_id % 300 AS code, user_id % 2 AS exam_id, ts FROM events WHERE event_id >= 300),
    l AS (SELECT u.*, c.exam_id AS made_for, u.exam_id = c.exam_id AND u.ts >= c.ts AND u.ts <= c.ts + INTERVAL 2 DAYS AS valid FROM u LEFT JOIN (SELECT event_id AS code, user_id % 2 AS exam_id, ts FROM events WHERE event_id < 300) c USING (code))
    SELECT use_id, coalesce(valid, FALSE) AND row_number() OVER (PARTITION BY code, coalesce(valid, FALSE) ORDER BY ts, use_id) = 1 AS accepted FROM l""")
def pairing_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    codes = e.where("event_id < 300").select(F.col("event_id").alias("code"), (F.col("user_id") % 2).alias("exam_id"), "ts")
    uses = e.where("event_id >= 300").select(F.col("event_id").alias("use_id"), (F.col("event_id") % 300).alias("code"), (F.col("user_id") % 2).alias("exam_id"), "ts")
    return S.paired(codes, uses, 2 * 86400).select("use_id", "accepted")


@query("""WITH s AS (SELECT DISTINCT 't' || user_id AS token, 's' || user_id AS student_id FROM events WHERE user_id % 10 <> 9),
    c AS (SELECT event_id, 't' || user_id AS token, CASE event_id % 4 WHEN 0 THEN 's' || user_id WHEN 1 THEN '' WHEN 3 THEN 'other' END AS claimed FROM events)
    SELECT event_id, CASE WHEN coalesce(claimed, '') = '' OR claimed = student_id THEN nullif(student_id, '') END AS student_id FROM c LEFT JOIN s USING (token)""")
def session_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sessions = e.where("user_id % 10 <> 9").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("student_id")).distinct()
    case = F.col("event_id") % 4
    own = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    claims = e.select("event_id", F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), F.when(case == 0, own).when(case == 1, "").when(case == 3, F.lit("other")).alias("claimed"))
    return S.resolved(claims, sessions).select("event_id", "student_id")


@query("SELECT c_custkey AS extension, c_name AS installed_name, n_name AS blacklist_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey < 8 AND c_custkey % 3 <> 0")
def blacklist_join(spark, sf_dir):
    installed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("extension"), F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 != 0).alias("enabled"))
    blacklist = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return S.blacklisted(installed, blacklist).select("extension", "installed_name", "blacklist_name")


@query("""WITH a AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'client_alert' ELSE event_type END AS kind, CASE WHEN event_id % 4 = 1 THEN '' ELSE repeat(props, 60) END AS d, epoch_us(ts) AS us FROM events)
    SELECT substr(sha256(concat_ws('|', user_id::VARCHAR, us::VARCHAR, kind, d)), 1, 32) AS event_id, user_id AS student_id, ts, substr(kind, 1, 80) AS type,
    substr(CASE WHEN event_id % 6 = 1 THEN repeat('r', 90) ELSE kind END, 1, 80) AS reason, substr(d, 1, 1000) AS details, substr(repeat('u', (event_id % 30 * 100)::INT), 1, 2000) AS tab_url,
    CASE WHEN event_id % 2 = 0 THEN substr(repeat('t', (event_id % 900)::INT), 1, 500) ELSE '' END AS tab_title, least(event_id % 70, 50) AS n_extensions,
    CASE WHEN event_id % 5 = 0 THEN 'clean' ELSE 'suspicious' END AS analysis_status, 'ŞÜPHELİ' AS verdict, CASE WHEN d = '' THEN 'Kural tabanlı alarm.' ELSE d END AS agent_reason FROM a""")
def alert_normalise(spark, sf_dir):
    none, eid = F.lit(None).cast("string"), F.col("event_id")
    alerts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("student_id"), "ts", F.when(eid % 3 != 0, F.col("event_type")).otherwise("").alias("type"), F.when(eid % 6 == 1, F.repeat(F.lit("r"), F.lit(90))).alias("reason"),
        F.when(eid % 4 != 1, F.repeat("props", F.lit(60))).alias("details"), F.repeat(F.lit("u"), (eid % 30 * 100).cast("int")).alias("tab_url"),
        F.when(eid % 2 == 0, F.repeat(F.lit("t"), (eid % 900).cast("int"))).alias("tab_title"), F.when(eid % 70 != 0, F.array_repeat(F.lit("x"), (eid % 70).cast("int"))).alias("extensions"),
        F.when(eid % 5 == 0, "clean").alias("analysis_status"), F.lit("").alias("verdict"), none.alias("agent_reason"),
    )
    made = S.alerts_normalised(alerts)
    return made.withColumn("n_extensions", F.size("extensions").cast("long")).drop("extensions")


#: Half of the payloads name their exam themselves, one of them by null; all have nested values.
@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'mine' WHEN 2 THEN NULL ELSE 'E1' END AS exam_id, event_id % 4 <> 2 AS exam_named, '2024' AS started_at, event_type AS kind, user_id::VARCHAR AS student,
    event_id::VARCHAR AS n, (event_id % 2 = 0)::VARCHAR AS suspicious, '[1,{"a":null}]' AS listed, FALSE AS image FROM events""")
def evidence_metadata(spark, sf_dir):
    e, eid = table(spark, sf_dir, "events"), F.col("event_id")
    quoted = lambda name, value: F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('"'))
    exam = F.when(eid % 4 == 0, '"examId":"mine",').when(eid % 4 == 2, '"examId":null,').otherwise("")
    payload = F.concat(
        F.lit("{"), exam, F.lit('"screenshot":"b64","filename":"f.jpg","l":[1,{"a":null}],'), quoted("kind", F.col("event_type")), F.lit(',"n":'), eid.cast("string"),
        F.lit(',"suspicious":'), (eid % 2 == 0).cast("string"), F.lit(',"student":{'), quoted("id", F.col("user_id")), F.lit("}}"),
    )
    made = e.select("event_id", S.evidence_metadata(payload, F.lit("E1"), F.lit("2024"), F.lit("CODE")).alias("m"))
    at = lambda path: F.get_json_object("m", path)
    return made.select(
        "event_id", at("$.examId").alias("exam_id"), (~F.contains("m", F.lit('"examId":null'))).alias("exam_named"), at("$.examStartedAt").alias("started_at"), at("$.kind").alias("kind"),
        at("$.student.id").alias("student"), at("$.n").alias("n"), at("$.suspicious").alias("suspicious"), at("$.l").alias("listed"), F.contains("m", F.lit("b64")).alias("image"),
    )


@query("""SELECT event_id, '{"active":' || (user_id % 2 = 0)::VARCHAR || ',"name":"' || event_type || '","minutes":' || event_id || '}' AS state FROM events""")
def public_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_id") % 3 > 0, ',"exam_code":"S3"').otherwise("")
    state = F.concat(F.lit('{"active":'), (F.col("user_id") % 2 == 0).cast("string"), code, F.lit(',"name":"'), F.col("event_type"), F.lit('","minutes":'), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", S.public_state(state).alias("state"))


#: Browsers of six windows or so: a student's events are tabs.
@query(f"""WITH {_E}, t AS (SELECT student_id AS client_id, event_id % 6 AS window_id, event_id % 6 = 4 AS focused, event_id AS place, event_id % 3 <> 1 AS active, CASE WHEN event_id % 5 = 0 THEN 'chrome://newtab' ELSE tab_url END AS url FROM e)
    SELECT client_id, window_id, place, url FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY focused DESC, place) AS n FROM t WHERE active AND starts_with(url, 'http')) WHERE n = 1""")
def active_tab(spark, sf_dir):
    eid = F.col("event_id")
    url = F.when(eid % 5 == 0, "chrome://newtab").otherwise(F.col("tab_url"))
    tabs = _events(spark, sf_dir).select(F.col("student_id").alias("client_id"), (eid % 6).alias("window_id"), (eid % 6 == 4).alias("focused"), eid.alias("place"), (eid % 3 != 1).alias("active"), url.alias("url"))
    return S.active_tab(tabs).select("client_id", "window_id", "place", "url")


@query(f"""WITH {_EV}, x AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, event_id DESC) AS n FROM ev WHERE exam = 2 QUALIFY n <= 1000)
    SELECT event_id, event_id AS listed_id, 'exam2' AS exam_id, kind, 'unknown' AS student_id, (SELECT count(*) FROM x) AS event_count, '' AS exam_code FROM x""")
def export_manifest(spark, sf_dir):
    about, events = S.manifest(_evidence(spark, sf_dir), "exam2")
    at = lambda path: F.get_json_object("event", path)
    listed = events.select("event_id", at("$.eventId").alias("listed_id"), at("$.examId").alias("exam_id"), at("$.kind").alias("kind"), "student_id")
    return listed.crossJoin(F.broadcast(about.select(F.col("eventCount").alias("event_count"), F.col("examCode").alias("exam_code"))))
