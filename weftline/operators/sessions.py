"""Events of monitored exam sessions, in batch: routing, votes, presence, throttles, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import hotkeys, ranges

#: Reasons, processes and words that route an event.
DIRECT_REASONS = ("tab_switch", "new_tab_attempt", "ai_extension_detected", "resource_access")
FORCED_REASONS = ("window_unfocused", "desktop_unfocused", "periodic", "desktop_periodic")
ALLOWED_PROCESSES = (
    "code.exe", "pycharm64.exe", "idea64.exe", "rider64.exe", "webstorm64.exe", "devenv.exe", "sublime_text.exe", "notepad++.exe",
    "cursor.exe", "chrome.exe", "msedge.exe", "firefox.exe", "cmd.exe", "powershell.exe", "windows terminal.exe", "wt.exe", "explorer.exe",
)
BLOCKED_WORDS = (
    "chatgpt", "chat.openai.com", "claude", "gemini", "perplexity", "deepseek", "copilot chat", "whatsapp", "telegram", "instagram",
    "twitter", "x.com", "facebook", "youtube",
)
RISKY_WORDS = ("stackoverflow", "stack overflow", "chegg", "coursehero", "brainly", "reddit", "quora")
#: Limits in seconds, counts and characters.
VOTES, VOTES_NEEDED = 3, 2
STALE_SECONDS, TIMEOUT_SECONDS, PAIRING_SECONDS = 90, 20, 120
THROTTLE_SECONDS, THROTTLE_ATTEMPTS = 60, 10
UNFOCUS_SECONDS, COOLDOWN_SECONDS = 3, 7
HISTORY_DEFAULT, HISTORY_MOST = 200, 1000
SCREENSHOT_BYTES = 5 * 1024 * 1024
LIMITS = {"type": 80, "reason": 80, "details": 1000, "tab_url": 2000, "tab_title": 500, "extensions": 50}


def _first_word(words: tuple[str, ...], hay: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)), F.lit(0))


def routed(events: DataFrame) -> DataFrame:
    """Adds route, risk and hit (the first listed word or process that decided) to events with reason,
    mode, tab_url, tab_title, window_title, active_process."""
    process = F.lower(F.coalesce("active_process", F.lit("")))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("tab_url", "tab_title", "window_title")]
    hay = F.lower(F.concat_ws(" ", *parts, process))
    e = events.withColumns({"_hard": _first_word(BLOCKED_WORDS, hay), "_risky": _first_word(RISKY_WORDS, hay), "_process": process})
    direct, coding, forced = F.col("reason").isin(*DIRECT_REASONS), F.col("mode") == "coding", F.col("reason").isin(*FORCED_REASONS)
    foreign = (F.col("_process") != "") & ~F.col("_process").isin(*ALLOWED_PROCESSES)
    rules = [
        (direct, "direct_alert", "high", None),
        (coding & F.col("_hard").isNotNull(), "direct_alert", "high", "_hard"),
        (coding & F.col("_risky").isNotNull(), "require_vlm", "medium", "_risky"),
        (coding & foreign, "require_vlm", "medium", "_process"),
        (coding & forced, "require_vlm", "low", None),
        (coding, "direct_clean", "low", None),
        (forced, "require_vlm", "medium", None),
    ]
    pick = lambda k, last: reduce(lambda acc, r: F.when(r[0], k(r)).otherwise(acc), reversed(rules), last)
    return e.withColumns(
        {
            "route": pick(lambda r: F.lit(r[1]), F.lit("require_vlm")),
            "risk": pick(lambda r: F.lit(r[2]), F.lit("low")),
            "hit": pick(lambda r: F.col(r[3]) if r[3] else F.lit(None).cast("string"), F.lit(None).cast("string")),
        }
    ).drop("_hard", "_risky", "_process")


def smoothed(results: DataFrame) -> DataFrame:
    """Adds confirmed, status, verdict_out and channel to results (exam_id, student_id, ts, event_id, mode, reason, suspicious, verdict).

    In coding mode, periodic results vote: suspicion is confirmed by two of a student's last three votes
    in the exam. A failed analysis votes too, as clean, and is uncertain. Only votes enter the window.
    """
    votes = (F.col("mode") == "coding") & F.col("reason").isin("periodic", "desktop_periodic")
    results = results.withColumn("_votes", F.coalesce(votes, F.lit(False)))
    last = Window.partitionBy("exam_id", "student_id", "_votes").orderBy("ts", "event_id").rowsBetween(1 - VOTES, 0)
    suspicious = F.coalesce("suspicious", F.lit(False))
    enough = (F.count(F.lit(1)).over(last) >= VOTES) & (F.sum(suspicious.cast("int")).over(last) >= VOTES_NEEDED)
    confirmed = suspicious & F.when(F.col("_votes"), enough).otherwise(True)
    failed = F.coalesce(F.col("verdict") == "HATA", F.lit(False))
    open_ = suspicious & ~F.col("confirmed")
    return (
        results.withColumn("confirmed", confirmed)
        .withColumns(
            {
                "status": F.when(failed | open_, "uncertain").when(F.col("confirmed"), "suspicious").otherwise("clean"),
                "verdict_out": F.when(failed, "HATA").when(open_, "BELİRSİZ").otherwise(F.coalesce("verdict", F.lit("BELİRSİZ"))),
                "channel": F.when(F.col("confirmed") & ~failed, "alert").otherwise("screenshot"),
            }
        )
        .withColumn("kept", F.col("status").isin("suspicious", "uncertain"))
        .drop("_votes")
    )


def timed_out(events: DataFrame, results: DataFrame, seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """Adds to events (event_id, ts) the first result within the time, or `timed_out`. results: event_id, done_at, suspicious, verdict."""
    # equal events are one row with a count until each has its result
    once = events.groupBy(*events.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    limit = F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col("event_id") == F.col("_event")) & (F.col("done_at") <= limit) & (F.col("done_at") >= F.col("ts"))
    rest = [c for c in results.columns if c != "event_id"]
    first = F.min(F.when(F.col("_event").isNotNull(), F.struct("done_at", F.struct(*rest).alias("r"))))
    picked = once.join(results.withColumnRenamed("event_id", "_event"), near, "left").groupBy(*events.columns, "_copies").agg(first.alias("f"))
    each = picked.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return each.select(*events.columns, "f.r.*", F.col("f").isNull().alias("timed_out"))


def alert_counts(events: DataFrame) -> DataFrame:
    """Alerts per exam and student: direct ones, confirmed suspicions of the exam itself, and client alerts."""
    counts = (F.col("route") == "direct_alert") | ((F.col("status") == "suspicious") & (F.col("exam_id") == F.col("current_exam"))) | (F.col("kind") == "client_alert")
    return events.groupBy("exam_id", "student_id").agg(F.count_if(F.coalesce(counts, F.lit(False))).alias("alerts"))


def presence(events: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """student_id, last_seen, status: of (student_id, ts, event_id, state in active/left), idle if active but unseen for too long."""
    last = events.groupBy("student_id").agg(F.max("ts").alias("last_seen"), F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    stale = (F.col("state") == "active") & (F.col("last_seen") < now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return last.select("student_id", "last_seen", F.when(stale, "idle").otherwise(F.col("state")).alias("status"))


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def exam_intervals(commands: DataFrame) -> DataFrame:
    """exam_id, started_at, ended_at of each start among (ts, action start/stop, exam_id, minutes).

    An exam ends at its stop, at the next start, or after its minutes, whichever comes first. Commands of
    one instant are ordered by exam_id. Commands are dealt by ranges of time that hold about as many each.
    """
    own = commands.withColumn("_cell", ranges.cell(_us(F.col("ts")), ranges.edges(commands, _us(F.col("ts")))))
    cells = own.groupBy("_cell").agg(F.min("ts").alias("_first"))
    # one row for each cell with commands; commands themselves are ordered within their cells
    cells = cells.select(F.col("_cell").alias("_c"), F.lead("_first").over(Window.orderBy("_cell")).alias("_after"))
    following = F.lead(F.struct("ts")).over(Window.partitionBy("_cell").orderBy("ts", "exam_id"))
    ended = own.withColumn("_next", following).join(F.broadcast(cells), F.col("_cell").eqNullSafe(F.col("_c"))).where("action = 'start'")
    ended = ended.withColumn("next_ts", F.when(F.col("_next").isNull(), F.col("_after")).otherwise(F.col("_next.ts")))
    over = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.greatest(F.col("minutes"), F.lit(0)) * 60).cast("decimal(18,6)"))
    return ended.select("exam_id", F.col("ts").alias("started_at"), F.least(over, F.coalesce("next_ts", over)).alias("ended_at"))


def as_of(events: DataFrame, marks: DataFrame, order: str, cells: int | None = None) -> DataFrame:
    """Adds `mark` to the events: of the marks (ts and more) not after an event's ts, the last one; of one instant, that with the largest `order`.

    Events and marks are dealt by ranges of time that hold about as many events each, and merged in each range by one
    ordering; the mark that is open where a range begins is carried into it as a row of its own. An instant that fills
    several ranges by itself is dealt over as many cells by a hash. So events meet no more than one shuffle, however they cluster.
    Ranges are at most MOST_CELLS, and so the carried rows.
    """
    us, rank = _us(F.col("ts")), F.struct(F.col("ts"), F.col(order))
    cuts = ranges.edges(events, us, cells)
    full = ranges.crowded(cuts)
    spark = events.sparkSession
    e = events.select(us.alias("_us"), F.struct(*events.columns).alias("e"))
    m = marks.where(F.col("ts").isNotNull()).select(us.alias("_us"), rank.alias("_rank"), F.struct(*marks.columns).alias("x"))
    e = e.withColumns({"_cell": ranges.cell(F.col("_us"), cuts), "_sub": ranges.dealt(F.col("_us"), cuts, F.col("e"))})
    m = m.withColumn("_cell", ranges.cell(F.col("_us"), cuts))
    # the mark that is open at a cut: the last before it, and for a crowded instant's further cells the last not after it
    starts = [(ranges.position(c, cuts), 0, c - 1) for c in sorted(set(cuts))] + [(ranges.position(v, cuts), i, v) for v, n in full.items() for i in range(1, n + 2)]
    opens = spark.createDataFrame([(c, s, limit) for c, s, limit in starts], "_cell int, _sub int, _limit long")
    last = m.groupBy("_cell").agg(F.max(F.struct("_rank", "x")).alias("l"))
    before = last.select((F.col("_cell") + 1).alias("c"), F.col("l").alias("before"))
    spread = opens.select("_cell").distinct().join(F.broadcast(before), F.col("c") <= F.col("_cell"), "left").groupBy("_cell").agg(F.max("before").alias("before"))
    here = opens.where("_sub > 0").join(m.select(F.col("_cell").alias("c"), F.col("_us").alias("at"), F.struct("_rank", "x").alias("l")), (F.col("c") == F.col("_cell")) & (F.col("at") <= F.col("_limit")), "left")
    here = here.groupBy("_cell", "_sub").agg(F.max("l").alias("here"))
    carried = opens.join(F.broadcast(spread), "_cell", "left").join(F.broadcast(here), ["_cell", "_sub"], "left").withColumn("l", F.coalesce("here", "before"))
    kind, row = m.schema["x"].dataType, e.schema["e"].dataType
    rows = e.select("_cell", "_sub", "_us", F.lit(2).alias("_kind"), F.lit(None).cast(m.schema["_rank"].dataType).alias("_rank"), F.lit(None).cast(kind).alias("x"), "e")
    rows = rows.unionByName(m.select("_cell", F.lit(0).alias("_sub"), "_us", F.lit(1).alias("_kind"), "_rank", "x", F.lit(None).cast(row).alias("e")))
    rows = rows.unionByName(carried.where("l IS NOT NULL").select("_cell", "_sub", F.lit(-(2**63)).alias("_us"), F.lit(0).alias("_kind"), F.col("l._rank").alias("_rank"), F.col("l.x").alias("x"), F.lit(None).cast(row).alias("e")))
    upto = Window.partitionBy("_cell", "_sub").orderBy("_us", "_kind", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mark", F.last("x", ignorenulls=True).over(upto)).where("e IS NOT NULL").select("e.*", F.when(F.col("e.ts").isNotNull(), F.col("mark")).alias("mark"))


def during_exam(events: DataFrame, exams: DataFrame) -> DataFrame:
    """Events with the exam that ran when they arrived. Exams follow one another, so that the latest start decides."""
    marks = exams.select(F.col("started_at").alias("ts"), "exam_id", "started_at", "ended_at")
    running = as_of(events, marks, "exam_id").withColumn("mark", F.when(F.col("ts") < F.col("mark.ended_at"), F.col("mark")))
    return running.select(*events.columns, F.col("mark.exam_id").alias("exam_id"), F.col("mark.started_at").alias("exam_started_at"))


def paired(codes: DataFrame, uses: DataFrame, seconds: int = PAIRING_SECONDS) -> DataFrame:
    """Each use (use_id, code, exam_id, ts) with `accepted`: the first in time of a code of the same exam, within its life.

    Codes and use_ids are unique. Uses of a heavy code stay where they are; the winner of each code is found by an aggregate.
    """
    made = codes.select("code", F.col("exam_id").alias("_exam"), F.col("ts").alias("_made"))
    keyed = uses.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).join(made, "code", "left")
    live = ranges.join_split(uses, keyed, ["code"], "_n")
    end = F.col("_made") + F.expr(f"INTERVAL {seconds} SECONDS")
    valid = F.coalesce((F.col("exam_id") == F.col("_exam")) & (F.col("ts") >= F.col("_made")) & (F.col("ts") < end), F.lit(False))
    place = F.struct("ts", "use_id")
    winners = live.where(valid).groupBy("code").agg(F.min(place).alias("_first"))
    rest = uses.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).join(winners, "code", "left")
    won = ranges.join_split(live.drop("_n"), rest, ["code"], "_n")
    return won.withColumn("accepted", F.coalesce(valid & (place == F.col("_first")), F.lit(False))).select(*uses.columns, "accepted")


def resolved(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds student_id to claims (token, claimed): the token's student, unless another one is claimed."""
    joined = claims.join(sessions.select("token", F.col("student_id").alias("_s")), "token", "left")
    fine = F.coalesce("claimed", F.lit("")).isin("") | (F.col("claimed") == F.col("_s"))
    return joined.withColumn("student_id", F.when(fine & (F.col("_s") != ""), F.col("_s"))).drop("_s")


def blacklisted(installed: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Enabled extensions that are on the list (id, name), with both names."""
    return installed.where("enabled").join(blacklist.select("id", F.col("name").alias("blacklist_name")), "id").withColumnRenamed("name", "installed_name")


def alerts_normalised(alerts: DataFrame) -> DataFrame:
    """Client alerts with defaults and limits; the id is made here, the token is not kept. `extensions` is an array."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    cut = lambda c, name: F.substring(c, 1, LIMITS[name])
    kind = F.coalesce(blank("type"), F.lit("client_alert"))
    details = F.coalesce("details", F.lit(""))
    return alerts.select(
        F.substring(F.sha2(F.concat_ws("|", "student_id", F.unix_micros(F.col("ts").cast("timestamp")), kind, details), 256), 1, 32).alias("event_id"),
        "student_id", "ts", cut(kind, "type").alias("type"), cut(F.coalesce(blank("reason"), kind), "reason").alias("reason"),
        cut(details, "details").alias("details"), cut(F.coalesce("tab_url", F.lit("")), "tab_url").alias("tab_url"),
        cut(F.coalesce("tab_title", F.lit("")), "tab_title").alias("tab_title"),
        F.slice(F.coalesce("extensions", F.array().cast(alerts.schema["extensions"].dataType)), 1, LIMITS["extensions"]).alias("extensions"),
        F.coalesce(blank("analysis_status"), F.lit("suspicious")).alias("analysis_status"),
        F.coalesce(blank("verdict"), F.lit("ŞÜPHELİ")).alias("verdict"),
        F.coalesce(blank("agent_reason"), blank("details"), F.lit("Kural tabanlı alarm.")).alias("agent_reason"),
    )


def unfocus_episodes(focus: DataFrame, seconds: int = UNFOCUS_SECONDS) -> DataFrame:
    """student_id, since, until of unfocused spans that last long enough, from (student_id, ts, event_id, focused).

    Consecutive events of one state are one span; a span that never ends counts. Ties on time go by event_id.
    """
    own = Window.partitionBy("student_id").orderBy("ts", "event_id")
    change = focus.withColumn("_before", F.lag("focused").over(own)).where("_before IS NULL OR _before <> focused")
    spans = change.withColumn("until", F.lead("ts").over(own)).where("NOT focused")
    long = F.col("until").isNull() | (F.col("until") >= F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return spans.where(long).select("student_id", F.col("ts").alias("since"), "until")


def changed_urls(visits: DataFrame) -> DataFrame:
    """Visits (tab_id, ts, event_id, url) whose URL differs from the tab's one before."""
    own = Window.partitionBy("tab_id").orderBy("ts", "event_id")
    return visits.withColumn("_b", F.lag("url").over(own)).where("NOT (url <=> _b)").drop("_b")


def throttled(attempts: DataFrame, chunk: int | None = None) -> DataFrame:
    """Adds `blocked` to attempts (addr, ts, event_id, flag: right code).

    Ten wrong codes within the last minute block further ones; blocked attempts are not counted, and a right code clears the count.
    """

    def step(held, t, right):
        held = tuple(x for x in held if x >= t - THROTTLE_SECONDS * 1_000_000)
        if len(held) >= THROTTLE_ATTEMPTS:
            return held, True
        return (() if right else (*held, t)), False

    return hotkeys.sequential(attempts, "addr", step, "blocked", chunk=chunk)


def cooled_down(events: DataFrame, seconds: int = COOLDOWN_SECONDS, chunk: int | None = None) -> DataFrame:
    """Adds `emitted` to events (student_id, ts, event_id): at least so long after the last emitted one."""

    def step(last, t, _):
        go = not last or t >= last[0] + seconds * 1_000_000
        return ((t,) if go else last), go

    return hotkeys.sequential(events.withColumn("flag", F.lit(True)), "student_id", step, "emitted", seconds * 1_000_000, chunk).drop("flag")


def gaps(events: DataFrame, seconds: int) -> DataFrame:
    """student_id, window start, n of tumbling windows in which a student reported, and how many windows were silent before."""
    cells = events.groupBy("student_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    start = F.col("w.start")
    before = F.lag(start).over(Window.partitionBy("student_id").orderBy(start))
    silent = F.coalesce((F.unix_timestamp(start.cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))) / seconds - 1, F.lit(0)).cast("long")
    return cells.select("student_id", start.alias("window_start"), "n", silent.alias("silent_before"))


def countdown(exams: DataFrame, now: Column) -> DataFrame:
    """exam_id and seconds left, not below 0."""
    return exams.select("exam_id", F.greatest(F.unix_timestamp(F.col("ended_at").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp")), F.lit(0)).alias("seconds_left"))


def latest_evidence(evidence: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The last written row of each event_id."""
    rest = [c for c in evidence.columns if c != "event_id"]
    return evidence.groupBy("event_id").agg(F.max_by(F.struct(*rest), seq).alias("e")).select("event_id", "e.*")


def listed(evidence: DataFrame, limit: int = HISTORY_DEFAULT, exam_id: str | None = None) -> DataFrame:
    """The newest evidence without images; the limit is kept between 1 and HISTORY_MOST. Ties go by event_id."""
    rows = evidence.drop("image")
    if exam_id is not None:
        rows = rows.where(F.get_json_object("metadata", "$.examId") == exam_id)
    return rows.orderBy(F.desc("created_at"), F.desc("event_id")).limit(max(1, min(limit, HISTORY_MOST)))


def history_items(evidence: DataFrame) -> DataFrame:
    """Adds has_image and evidence_id (only with an image)."""
    image = F.startswith(F.coalesce("mime_type", F.lit("")), F.lit("image/"))
    return evidence.withColumns({"has_image": image, "evidence_id": F.when(image, F.col("event_id"))})


def exam_history(evidence: DataFrame, limit: int = HISTORY_MOST) -> DataFrame:
    """Per exam, over the newest `limit` rows: fields of its newest row, counts and last event, newest exam first.

    evidence: event_id, created_at, exam_id, exam_code, started_at, mode, status, suspicious. Limit before aggregation.
    started_at and mode are those of the newest row even where it has none (then ''); exam_code is the newest that is not empty.
    """
    newest = evidence.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    order = F.struct("created_at", "event_id")
    filled = F.nullif("exam_code", F.lit(""))
    bad = F.coalesce(F.col("status") == "suspicious", F.lit(False)) | F.coalesce("suspicious", F.lit(False))
    # a value in a struct is never null, so that the newest row's own value counts
    first = lambda c: F.coalesce(F.max_by(F.struct(F.col(c).cast("string").alias("v")), order)["v"], F.lit(""))
    return (
        newest.where("exam_id IS NOT NULL AND exam_id <> ''")
        .groupBy("exam_id")
        .agg(
            F.coalesce(F.max_by(filled, F.when(filled.isNotNull(), order)), F.lit("")).alias("exam_code"),
            first("started_at").alias("started_at"),
            first("mode").alias("mode"),
            F.max("created_at").alias("last_event_at"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(bad).alias("suspicious_count"),
        )
        .orderBy(F.desc(F.coalesce(F.nullif("started_at", F.lit("")), F.col("last_event_at").cast("string"))), "exam_id")
    )


def legacy_count(evidence: DataFrame, limit: int = HISTORY_MOST) -> DataFrame:
    """One row: how many of the newest `limit` rows belong to no exam."""
    newest = evidence.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    return newest.agg(F.count_if(F.coalesce(F.col("exam_id"), F.lit("")) == "").alias("legacy_count"))


def card(status: Column, kind: Column, verdict: Column, alert_channel: Column) -> Column:
    """The dashboard class of an event."""
    known = F.coalesce(F.nullif(status, F.lit("")), F.when(alert_channel, "suspicious").otherwise("clean"))
    return (
        F.when(known.isin("pending", "uncertain"), known)
        .when(kind == "ai_extension_detected", "critical")
        .when(known == "suspicious", F.when(F.coalesce(verdict == "ŞÜPHELİ", F.lit(False)), "agent-flag").otherwise("suspicious"))
        .otherwise("periodic")
    )


def badge(alerts: Column) -> Column:
    return F.when(alerts == 0, "zero").when(alerts <= 2, "low").otherwise("high")


def dashboard(events: DataFrame) -> DataFrame:
    """One row: distinct events and alerts among them; events without an id are told apart by time, reason and student."""
    own = F.coalesce("event_id", F.concat_ws("-", F.col("ts").cast("string"), "reason", F.coalesce("student_id", F.lit("x"))))
    bad = F.coalesce(F.col("status") == "suspicious", F.lit(False)) | F.coalesce("suspicious", F.lit(False))
    once = events.groupBy(own.alias("id")).agg(F.min_by(bad, "seq").alias("bad"))
    return once.agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("alerts"))


def screenshot(data_url: Column) -> tuple[Column, Column]:
    """(status, mime): 200 with the type of a sound JPEG or PNG, 413 if too large, else 400."""
    body = F.when(F.contains(data_url, F.lit(",")), F.split_part(data_url, F.lit(","), F.lit(2)))
    image = F.try_to_binary(body, F.lit("base64"))
    head = F.hex(F.substring(image, 1, 8))
    mime = F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(head == "89504E470D0A1A0A", "image/png")
    good = F.startswith(data_url, F.lit("data:image/")) & image.isNotNull() & mime.isNotNull()
    large = F.octet_length(image) > SCREENSHOT_BYTES
    return F.when(F.coalesce(large, F.lit(False)), 413).when(F.coalesce(good, F.lit(False)), 200).otherwise(400), F.when(good & ~large, mime)


def _object(payload: Column) -> Column:
    """The fields of a JSON object as they are, nested ones too; null if the text is no object."""
    return F.from_json(payload, "map<string,variant>")


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def evidence_metadata(payload: Column, exam_id: Column, started_at: Column, exam_code: Column) -> Column:
    """The payload (JSON text) without screenshot and filename; exam fields are added only where absent, not where null."""
    kept = F.map_filter(_object(payload), lambda k, _: ~k.isin("screenshot", "filename"))
    for name, value in (("examId", exam_id), ("examStartedAt", started_at), ("examCode", exam_code)):
        kept = F.when(F.map_contains_key(kept, name), kept).otherwise(F.map_concat(kept, F.create_map(F.lit(name), value.cast("string").cast("variant"))))
    return _json(kept)


def public_state(state: Column) -> Column:
    """The exam's state (JSON text) as everybody may see it: without its code."""
    return _json(F.map_filter(_object(state), lambda k, _: k != "exam_code"))


def manifest_event(event_id: Column, metadata: Column) -> Column:
    """An event of an export's manifest: its id and the fields of its metadata, whose own eventId would win."""
    fields = F.coalesce(_object(metadata), F.create_map().cast("map<string,variant>"))
    own = F.create_map(F.lit("eventId"), event_id.cast("string").cast("variant"))
    return _json(F.when(F.map_contains_key(fields, "eventId"), fields).otherwise(F.map_concat(own, fields)))


def manifest(evidence: DataFrame, exam_id: str) -> tuple[DataFrame, DataFrame]:
    """(one row about the exam, its events newest first) of the newest HISTORY_MOST rows of an exam.

    The row holds examId, and of the newest event examCode and examStartedAt, and eventCount; events have
    event_id, student_id (unknown if there is none) and `event`, the JSON text of manifest_event.
    """
    rows = listed(evidence, HISTORY_MOST, exam_id)
    text = lambda path: F.coalesce(F.get_json_object("metadata", path), F.lit(""))
    newest = F.struct("created_at", "event_id")
    about = rows.agg(
        F.lit(exam_id).alias("examId"), F.coalesce(F.max_by(text("$.examCode"), newest), F.lit("")).alias("examCode"),
        F.coalesce(F.max_by(text("$.examStartedAt"), newest), F.lit("")).alias("examStartedAt"), F.count(F.lit(1)).alias("eventCount"),
    )
    student = F.coalesce(F.nullif(text("$.student.id"), F.lit("")), F.lit("unknown"))
    return about, rows.select("event_id", "created_at", student.alias("student_id"), manifest_event(F.col("event_id"), F.col("metadata")).alias("event"))


def active_tab(tabs: DataFrame) -> DataFrame:
    """Per browser (client_id) the tab to capture: the first active one that can be captured, tabs of the focused window first.

    tabs: client_id, window_id, focused, place (of the tab in the order of windows and tabs), active, url.
    """
    usable = tabs.where(F.col("active") & F.coalesce(F.col("url").rlike(r"(?i)^https?://"), F.lit(False)))
    order = F.struct((~F.coalesce("focused", F.lit(False))).alias("behind"), "place")
    rest = [c for c in tabs.columns if c != "client_id"]
    return usable.groupBy("client_id").agg(F.min_by(F.struct(*rest), order).alias("t")).select("client_id", "t.*")


def download_name(student_id: Column, reason: Column, event_id: Column) -> Column:
    return F.concat_ws("_", T.safe_name(student_id, "unknown"), T.safe_name(reason, "violation"), T.safe_name(event_id, "event"))
