"""Order-dependent rules against step-by-step restatements, and splits' invariants."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import coverage, dedup, external, merge, quota, sessions, split, validate
from weftline.sources.shared import durable


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(70):
        h = rng.choice(centres)
        for _ in range(rng.randrange(0, 4)):
            h ^= 1 << rng.randrange(64)
        rows.append((rng.choice("AB"), i, h - 2**64 if h >= 2**63 else h, f"f{h}" if rng.random() < 0.7 else f"g{i}"))
    kept: dict = {"A": [], "B": []}
    want = {}
    for p, i, h, f in rows:
        seen = [(k, g) for k, g in kept[p] if (k ^ h).bit_count() <= 3 or bin((k ^ h) & (2**64 - 1)).count("1") <= 3]
        if any(g == f for _, g in kept[p]):
            want[i] = ("exact_duplicate", 0)
        elif seen:
            want[i] = ("near_duplicate", bin((seen[0][0] ^ h) & (2**64 - 1)).count("1"))
        else:
            want[i] = ("kept", None)
            kept[p].append((h, f))
    frame = spark.createDataFrame(rows, "profile string, ord long, simhash long, fingerprint string")
    assert {r.ord: (r.status, r.distance) for r in dedup.greedy(frame, durable, 3).collect()} == want


def test_greedy_chain_and_state(spark):
    rows = spark.createDataFrame([("A", 1, 0b11, "b"), ("A", 2, 0b1111, "c"), ("A", 3, 0, "a")], "profile string, ord long, simhash long, fingerprint string")
    assert {r.ord: r.status for r in dedup.greedy(rows, durable, 2).collect()} == {1: "kept", 2: "near_duplicate", 3: "near_duplicate"}
    before = spark.createDataFrame([("A", 0, 0, "a")], rows.schema)
    got = {r.ord: (r.status, r.distance) for r in dedup.greedy(rows, durable, 2, before).collect()}
    assert got == {1: ("near_duplicate", 2), 2: ("kept", None), 3: ("exact_duplicate", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_renaming(spark, seed):
    rng = random.Random(seed)
    rows = [("_" * rng.randrange(3) + rng.choice(["1_FAST", "2_MEM"]), rng.randrange(2), i) for i in range(25)]
    rows += [("9_SLOW", 0, 100), ("9_SLOW", 1, 100)] + [("8_MEM", i % 3, 200 + i) for i in range(30)] + [("___5_FAST", 0, 300 + i) for i in range(4)]
    taken, want = set(), {}
    for key, src, line in sorted(rows, key=lambda r: r[1:]):
        new = key
        while new in taken:
            new = "_" + new
        taken.add(new)
        want[src, line] = new
    got = merge.renamed(spark.createDataFrame(rows, "_key string, src_idx int, line_no long")).collect()
    assert {(r.src_idx, r.line_no): r.new_key for r in got} == want


def test_votes(spark):
    rows = [("e", "s", i, i, "coding", "periodic", v, "ŞÜPHELİ") for i, v in enumerate([True, False, True, False, True])]
    rows += [("e", "s", 9, 9, "web", "periodic", True, "ŞÜPHELİ"), ("e", "t", 1, 11, "coding", "periodic", True, "HATA")]
    frame = spark.createDataFrame(rows, "exam_id string, student_id string, ts long, event_id long, mode string, reason string, suspicious boolean, verdict string")
    got = {r.event_id: (r.confirmed, r.status) for r in sessions.smoothed(frame).collect()}
    assert [got[i][0] for i in range(5)] == [False, False, True, False, True]
    assert got[0][1] == "uncertain" and got[2][1] == "suspicious" and got[3][1] == "clean" and got[9] == (True, "suspicious") and got[11][1] == "uncertain"


def test_throttle_and_cooldown(spark):
    times = [i * 2.0 for i in range(15)] + [61.0, 63.0, 90.0]
    rows = [("a", i, t, False) for i, t in enumerate(times)] + [("b", 100 + i, float(i), i == 9) for i in range(14)]
    frame = spark.createDataFrame(rows, "addr string, event_id long, s double, flag boolean").withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long")))
    got = {r.event_id: r.blocked for r in sessions.throttled(frame).collect()}
    assert [got[i] for i in range(18)] == [False] * 10 + [True] * 5 + [False, False, False]
    assert not any(got[100 + i] for i in range(14))
    calm = sessions.cooled_down(frame.where("addr = 'b'").withColumnRenamed("addr", "student_id"), 7)
    assert sorted(r.event_id for r in calm.collect() if r.emitted) == [100, 107]


def test_quotas(spark):
    assert quota.plan(50) == {"FAST": 17, "MEM": 17, "SLOW": 16}
    rows = spark.createDataFrame([("FAST", i) for i in range(40)] + [("MEM", i) for i in range(3)], "profile string, ord long")
    got = quota.admit(rows, {"FAST": 12, "MEM": 9, "SLOW": 1}, rows.where("ord < 5")).where("admitted")
    assert sorted((r.profile, r.ord) for r in got.collect()) == [("FAST", i) for i in range(7)] + [("MEM", i) for i in range(3)]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 15, 25])
def test_split_sizes(spark, n):
    rows = spark.range(n).select(F.lit("P").alias("profile"), F.col("id").cast("string").alias("_key"), F.lit("normal").alias("sample_type"))
    val = split.by_profile(rows).where("split = 'val'").count()
    assert val == (1 if n == 1 else min(max(round(n * 0.1), 1), n - 1))
    assert split.by_profile_and_type(rows).where("split = 'val'").count() == int(n * 0.1)
    first = {r._key for r in split.by_profile(rows).where("split = 'val'").collect()}
    assert first == {r._key for r in split.by_profile(rows.repartition(3)).where("split = 'val'").collect()}


def test_split_by_question(spark):
    rows = spark.createDataFrame([(q, p, f"{q}_{p}") for q in range(60) for p in ("FAST", "MEM")][:-1], "question int, profile string, _key string")
    got = split.by_question(rows)
    assert split.overlaps(got, "question").count() == 0
    sizes = {r.split: r.n for r in got.groupBy("split").agg(F.count_distinct("question").alias("n")).collect()}
    assert sizes == {"test": 6, "val": 6, "train": 48}
    tight = split.by_question(rows.where("question < 3"), 0.5, 0.5)
    assert {r.split: r.n for r in tight.groupBy("split").agg(F.count_distinct("question").alias("n")).collect()} == {"test": 2, "train": 1}


def test_validators(spark):
    schema = "k string, system string, m array<struct<role:string,content:string>>"
    u, a = ("user", "hi"), ("assistant", "ok?")
    cases = [
        ("fine", "S", [u, a]), ("no_list", "S", None), ("short", "S", [u]), ("blank", " ", [u, ("assistant", " ")]),
        ("role", "S", [u, ("tool", "x")]), ("order", "S", [u, u, a]), ("null", "S", [u, None]),
    ]
    frame = spark.createDataFrame(cases, schema)
    raw = {r.k: r.x for r in frame.select("k", validate.raw_reasons(F.col("m"), F.col("system")).alias("x")).collect()}
    assert raw == {
        "fine": [], "no_list": ["invalid_messages_list"], "short": ["invalid_messages_list"], "blank": ["invalid_system", "invalid_content_1"],
        "role": ["invalid_role_1"], "order": [], "null": ["message_not_object_1"],
    }
    full = frame.select("k", F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit("S").alias("content"))), F.coalesce("m", F.array())).alias("c"))
    chat = {r.k: r.x for r in full.select("k", validate.chatml_reasons(F.col("c")).alias("x")).collect()}
    assert chat["fine"] == [] and chat["order"] == ["not_alternating_2"] and chat["no_list"] == ["invalid_chatml_messages"]
    assert chat["blank"] == ["chatml_empty_content_2"] and chat["role"] == ["last_not_assistant", "not_alternating_2"]
    with pytest.raises(Exception, match="invalid record"):
        validate.assert_none(frame.select(F.col("k").alias("_key"), validate.raw_reasons(F.col("m"), F.col("system")).alias("reasons"))).collect()


def test_dead_letters(spark):
    lines = ['{"status":"kısmi","missing":["MEM","MEM",7],"qi":1}', "{", "3", '{"qi":1,"status":"kısmi"}', '{"status":"tam","missing":[],"qi":0}', '{"status":"kısmi","missing":[],"qi":1}',
             '{"status":"kısmi","missing":["FAST"],"qi":"1"}', '{"status":"kısmi","missing":["FAST"],"qi":9}', " ", '{"status":"kısmi","missing":null,"qi":1}']
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = sorted((r.line_no, r.error or "") for r in coverage.dead_letters(frame, 5).collect())
    assert got == [
        (0, ""), (0, "unknown_profile"), (1, "bad_json"), (2, "not_an_object"), (3, "missing_fields:missing"), (5, "missing_not_a_filled_list"),
        (6, "qi_not_an_integer"), (7, "qi_out_of_range"), (9, "missing_not_a_filled_list"),
    ]


def test_external_calls(spark):
    def service(prompt):
        if prompt == "down":
            raise external.Retryable("503")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    requests = spark.createDataFrame([("1", "hi"), ("2", "down"), ("3", "bad")], "_key string, prompt string")
    got = {r._key: r for r in external.call(requests, service, retries=2, base=0.001).collect()}
    assert got["1"].reply == "HI" and got["2"].error == "503" and got["2"].attempts == 3 and got["3"].error == "ValueError: no" and got["3"].attempts == 1
    assert [f(0.0) for f in (lambda j: external.backoff(0, j), lambda j: external.backoff(9, j))] == [pytest.approx(6.8), 60.0]
    talks = external.simulate(requests.select("_key", F.col("prompt").alias("source_question")), lambda q, said: f"{q}{len(said)}", lambda q, said: "why?", 2)
    assert [m.content for m in talks.where("_key = '1'").first().messages] == ["hi0", "why?", "hi2", "why?"]
    assert {(r._key, r.stage, r.attempts) for r in external.failures(external.call(requests, service, retries=0, base=0.001), "critic_api").collect()} == {("2", "critic_api", 1), ("3", "critic_api", 1)}


def test_rounds_of_calls(spark, tmp_path):
    marks = tmp_path / "seen"
    marks.mkdir()

    def service(prompt):
        if prompt == "down" or (prompt == "late" and not (marks / "late").exists()):
            (marks / prompt).touch()
            raise external.Retryable("503")
        return prompt.upper()

    requests = spark.createDataFrame([("1", "hi"), ("2", "down"), ("3", "late")], "_key string, prompt string")
    waits = []
    got = {r._key: r for r in external.call_with_rounds(requests, service, durable, (1.0, 2.0), waits.append, retries=0, base=0.001).collect()}
    assert waits == [1.0, 2.0]
    assert {k: (r.stage, r.reply, [e.attempt for e in r.error_history]) for k, r in got.items()} == {
        "1": ("done", "HI", []), "2": ("max_retry", None, [0, 1, 2]), "3": ("done", "LATE", [0]),
    }
    assert got["2"].error == "503"


def test_gated_dialogues(spark):
    external.distinct_models(("http://a/", "m"), ("http://b", "m"))
    with pytest.raises(ValueError):
        external.distinct_models(("http://A/", "m "), ("http://a", "m"))
    def student(question, said):
        return "I think it is so"

    def tutor(question, said):
        if question == "leak":
            return "The answer: doğru cevap! is it?"
        return "Why do you think so?" if len(said) < 3 else "Well done, that is all."

    rows = spark.createDataFrame([("1", "good"), ("2", "leak")], "_key string, source_question string")
    got = {r._key: r for r in external.simulate(rows, student, tutor, 2, min_turns=2, retries=1, least=10).collect()}
    assert len(got["1"].messages) == 4 and got["1"].error is None and len(got["1"].attempts) == 4
    assert got["2"].error == "tutor_reply_quality_error: direct_answer" and len(got["2"].messages) == 1 and len(got["2"].attempts) == 3
    tries = spark.createDataFrame(list(got.values())).select("_key", F.explode("attempts").alias("a")).select("_key", "a.*", F.lit(2).alias("max_turns"), F.lit(2).alias("min_turns"))
    flags = {r._key: r for r in validate.qc_flags(tries).collect()}
    assert flags["1"].tutor_closing_without_question == 1 and flags["1"].tutor_retry_count == 0 and flags["1"].error is None
    assert flags["2"].tutor_retry_count == 2 == flags["2"].tutor_direct_answer_detected and flags["2"].error == got["2"].error


def test_quarantine(spark):
    rows = spark.createDataFrame([("a", []), ("b", ["y", "x", "y"])], "_key string, reasons array<string>")
    valid, invalid = validate.quarantine(rows)
    assert valid.columns == ["_key"] and [r._key for r in valid.collect()] == ["a"] and invalid.first().reasons == ["x", "y"]


def test_finished_records(spark):
    """After duplicates, the profile's gate and quotas, in the order in which candidates came."""
    say = lambda *words: [("user", " ".join(words)), ("assistant", "so what is it?")]
    texts = [say(f"w{i}a", f"w{i}b", f"w{i}c", f"w{i}d") for i in range(6)]
    candidates = [
        ("FAST", 1, texts[0], "pass", "ok", True), ("FAST", 2, texts[0], "pass", "", True), ("FAST", 3, texts[1], "pass", "x", False), ("FAST", 4, texts[2], "review", None, True),
        ("FAST", 5, texts[2], "pass", "", True), ("FAST", 6, texts[3], "pass", "", True), ("FAST", 7, texts[4], "pass", "", True), ("FAST", 8, texts[5], "pass", "", True), ("MEM", 9, texts[0], "pass", "", True),
    ]
    kind = "array<struct<role:string,content:string>>"
    frame = spark.createDataFrame(candidates, f"profile string, ord long, messages {kind}, verdict string, note string, compliant boolean")
    passed = spark.createDataFrame([(" FAST", texts[5]), ("OTHER", texts[0]), ("MEM", [])], f"profile string, messages {kind}")
    assert quota.bootstrap(passed).count() == 1
    got = {r.ord: r for r in quota.finished(frame, {"FAST": 2, "MEM": 5, "SLOW": 0}, durable, passed.withColumn("profile", F.btrim("profile")), 1).collect()}
    assert {o: (r.outcome, r.verdict, r.note) for o, r in got.items()} == {
        1: ("passed", "pass", "ok"), 2: ("failed", "fail", "exact_duplicate"), 3: ("failed", "fail", "x | profile_noncompliant"), 4: ("failed", "review", ""),
        5: ("failed", "fail", "exact_duplicate"), 6: ("failed", "pass", "quota_reached"), 7: ("failed", "pass", "quota_reached"), 8: ("failed", "fail", "exact_duplicate"), 9: ("passed", "pass", ""),
    }


def test_repeated_events_stay_apart(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([("1", at(0), "x"), ("1", at(0), "x"), ("1", at(90), "x"), (None, at(5), None)], "event_id string, ts timestamp, extra string")
    results = spark.createDataFrame([("1", at(3), True), ("1", at(9), False)], "event_id string, done_at timestamp, suspicious boolean")
    got = sorted((r.event_id or "", r.ts.second, r.suspicious, r.timed_out) for r in sessions.timed_out(events, results).collect())
    assert got == [("", 5, None, True), ("1", 0, True, False), ("1", 0, True, False), ("1", 30, None, True)]
    twice = spark.createDataFrame([("a", "1", at(0)), ("a", "1", at(0)), ("b", "1", at(1))], "student_id string, event_id string, ts timestamp")
    assert sorted((r.student_id, r.emitted) for r in sessions.cooled_down(twice, 7).collect()) == [("a", False), ("a", True), ("b", True)]


def test_first_questions(spark):
    questions = spark.range(200).select(F.col("id").alias("qi"))
    assert {r.qi for r in quota.candidates(questions, first=5, most=80).collect()} == set(range(5, 85))


def test_exam_intervals_over_days(spark):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    seconds = sorted(rng.sample(range(9 * 86400), 60))
    rows = [(start + datetime.timedelta(seconds=s + (5 * 86400 if s > 4 * 86400 else 0)), rng.choice(["start", "stop"]), f"x{i}", rng.randrange(1, 20_000)) for i, s in enumerate(seconds)]
    want = set()
    for (ts, action, exam, minutes), following in zip(rows, [*rows[1:], None], strict=True):
        over = ts + datetime.timedelta(minutes=minutes)
        if action == "start":
            want.add((exam, ts, min(over, following[0]) if following else over))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        commands = spark.createDataFrame(rows, "ts timestamp, action string, exam_id string, minutes int").repartition(3)
        got = sessions.exam_intervals(commands).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    naive = {(r.exam_id, r.started_at.replace(tzinfo=None), r.ended_at.replace(tzinfo=None)) for r in got}
    assert naive == want and len({r.task for r in got}) > 1


def test_prompts(spark):
    row = spark.createDataFrame([("what?", "a" * 900, None)], "q string, a string, n string")
    made = row.select(external.prompt("Q: {q} A: {reference} {n} {other}", q=F.col("q"), reference=F.col("a"), n=F.col("n")).alias("p")).first().p
    assert made == "Q: what? A: " + "a" * 800 + "  {other}"
