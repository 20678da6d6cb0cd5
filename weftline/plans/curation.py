"""Queries on cleaning, merging, splitting and judging records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import replies as R
from weftline.functions import text as T
from weftline.operators import coverage as C
from weftline.operators import dedup, judge, merge, quota, reports, split
from weftline.operators import dialogues as D
from weftline.plans.dialogue import NORM_TEXT, SAN_TEXT, records
from weftline.sources.shared import durable
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


_P = "['FAST', 'MEM', 'SLOW'][(doc_id % 3 + 1)::INT]"


def _profile(column: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, D.PROFILES)), (F.pmod(F.col(column), F.lit(3)) + 1).cast("int"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# text -----------------------------------------------------------------------


@query(f"SELECT doc_id, md5({NORM_TEXT}) AS normalised, md5({SAN_TEXT}) AS sanitised FROM documents")
def text_sanitize(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise_space(text)).alias("normalised"), F.md5(T.sanitise(text)).alias("sanitised"))


_TOKENS = f"list_filter(string_split({SAN_TEXT}, ' '), lambda t: length(t) >= 3)"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents")
def text_tokens(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


#: The 64-bit SimHash of every document, as a signed number.
_SIMHASH = f"""tok AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
    h AS (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM tok),
    bits AS (SELECT doc_id, b, sum(((h >> b) & 1)::INT) AS ones, count(*) AS n FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY doc_id, b),
    sim AS (SELECT d.doc_id, coalesce(sum(CASE WHEN 2 * ones > n THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b::INT) END ELSE 0 END), 0)::BIGINT AS simhash
            FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id)"""


def _simhashes(spark, sf_dir):
    # sanitised once for both
    rows = _docs(spark, sf_dir).select("doc_id", T.sanitise(F.col("text")).alias("clean"))
    return rows.select("doc_id", _profile().alias("profile"), T.simhash64_clean(F.col("clean")).alias("simhash"), F.sha1("clean").alias("fingerprint"))


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sim")
def simhash64(spark, sf_dir):
    return _simhashes(spark, sf_dir).select("doc_id", "simhash")


#: Rows of equal hashes are one; pairs are of their first rows.
_HASHES = f"p AS (SELECT {_P} AS profile, doc_id, simhash FROM sim), k AS (SELECT profile, simhash, min(doc_id) AS doc_id, count(*) AS members FROM p GROUP BY profile, simhash)"


@query(f"""WITH {_SIMHASH}, {_HASHES}
    SELECT x.profile, x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash))::INT AS distance
    FROM k x JOIN k y ON x.profile = y.profile AND x.doc_id < y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3""")
def near_dup_pairs(spark, sf_dir):
    rows = _simhashes(spark, sf_dir).select("profile", F.col("doc_id").alias("ord"), "simhash")
    return dedup.near_pairs(durable(dedup.representatives(rows)), 3)


@query(f"WITH {_SIMHASH}, {_HASHES} SELECT p.profile, p.doc_id, k.doc_id AS representative, members FROM p JOIN k ON k.profile = p.profile AND k.simhash = p.simhash")
def near_dup_members(spark, sf_dir):
    rows = durable(_simhashes(spark, sf_dir).select("profile", F.col("doc_id").alias("ord"), "simhash"))
    first = dedup.representatives(rows).withColumnRenamed("ord", "representative")
    return rows.join(first, ["profile", "simhash"]).select("profile", F.col("ord").alias("doc_id"), "representative", "members")


_GREEDY = f"""{_SIMHASH}, p AS (
        SELECT {_P} AS profile, doc_id, simhash, sha1({SAN_TEXT}) AS fp, row_number() OVER (PARTITION BY {_P} ORDER BY doc_id) AS i FROM sim JOIN documents USING (doc_id)
    ), g AS (
        SELECT profile, i, doc_id, [simhash] AS kept, [fp] AS fps, 'kept' AS status, NULL::INT AS distance FROM p WHERE i = 1
        UNION ALL
        SELECT p.profile, p.i, p.doc_id,
               CASE WHEN list_contains(g.fps, p.fp) OR len(list_filter(g.kept, lambda k: bit_count(xor(k, p.simhash)) <= 3)) > 0 THEN g.kept ELSE list_append(g.kept, p.simhash) END,
               CASE WHEN list_contains(g.fps, p.fp) OR len(list_filter(g.kept, lambda k: bit_count(xor(k, p.simhash)) <= 3)) > 0 THEN g.fps ELSE list_append(g.fps, p.fp) END,
               CASE WHEN list_contains(g.fps, p.fp) THEN 'exact_duplicate' WHEN len(list_filter(g.kept, lambda k: bit_count(xor(k, p.simhash)) <= 3)) > 0 THEN 'near_duplicate' ELSE 'kept' END,
               CASE WHEN list_contains(g.fps, p.fp) THEN 0 ELSE bit_count(xor(list_filter(g.kept, lambda k: bit_count(xor(k, p.simhash)) <= 3)[1], p.simhash))::INT END
        FROM g JOIN p ON p.profile = g.profile AND p.i = g.i + 1
    )"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT profile, doc_id, status, distance FROM g")
def greedy_dedup(spark, sf_dir):
    rows = durable(_simhashes(spark, sf_dir).withColumnRenamed("doc_id", "ord"))
    return dedup.greedy(rows, durable, 3).select("profile", F.col("ord").alias("doc_id"), "status", "distance")


#: Judged candidates made of documents: what a verdict is after duplicates, the profile's gate and quotas.
@query(f"""WITH RECURSIVE {_GREEDY}, j AS (
        SELECT g.*, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'review' END END AS judged, doc_id % 13 = 0 AS wrong FROM g LEFT JOIN labels USING (doc_id)
    ), v AS (
        SELECT *, CASE WHEN wrong OR status <> 'kept' THEN 'fail' ELSE judged END AS verdict,
            'n' || CASE WHEN wrong THEN ' | profile_noncompliant' ELSE '' END || CASE status WHEN 'exact_duplicate' THEN ' | exact_duplicate' WHEN 'near_duplicate' THEN ' | near_duplicate_hamming_le_3' ELSE '' END AS note FROM j
    ), q AS (
        SELECT *, row_number() OVER (PARTITION BY profile, verdict = 'pass' ORDER BY doc_id) <= CASE profile WHEN 'FAST' THEN 20 WHEN 'MEM' THEN 40 ELSE 100000 END AS room FROM v
    ) SELECT profile, doc_id, verdict, CASE WHEN verdict = 'pass' AND room THEN 'passed' ELSE 'failed' END AS outcome, note || CASE WHEN verdict = 'pass' AND NOT room THEN ' | quota_reached' ELSE '' END AS note,
        CASE WHEN status = 'near_duplicate' THEN distance END AS duplicate_distance FROM q""")
def judged_outcomes(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    model = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").when(F.col("doc_id") % 2 == 0, "pass").otherwise("review")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    candidates = rows.select(
        _profile().alias("profile"), F.col("doc_id").alias("ord"), messages.alias("messages"), model.alias("verdict"), F.lit("n").alias("note"), (F.col("doc_id") % 13 != 0).alias("compliant")
    )
    done = quota.finished(candidates, {"FAST": 20, "MEM": 40, "SLOW": 100_000}, durable, distance=3)
    return done.select("profile", F.col("ord").alias("doc_id"), "verdict", "outcome", "note", "duplicate_distance")


# records made of documents and labels -----------------------------------------

#: Records whose keys collide: three documents or so share a key.
_RECORDS = f"""r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 97 = 5 THEN NULL ELSE (d.doc_id % 300) || '_' || {_P.replace('doc_id', 'd.doc_id')} END AS _key,
    CASE WHEN d.doc_id % 11 <> 3 THEN sha1({NORM_TEXT}) END AS msg_hash, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END AS judge,
    CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id % 5 END AS retries, (2 + d.n_chars % 20) AS length, (d.doc_id % 3) AS src_idx, d.doc_id AS line_no, text
    FROM documents d LEFT JOIN labels USING (doc_id))"""


def _records(spark, sf_dir):
    doc = F.col("doc_id")
    return (
        _docs(spark, sf_dir)
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            F.when(doc % 97 != 5, F.concat_ws("_", (doc % 300).cast("string"), _profile())).alias("_key"),
            F.when(doc % 11 != 3, F.sha1(T.normalise_space(F.col("text")))).alias("msg_hash"),
            F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("judge"),
            F.when(doc % 4 != 0, doc % 5).alias("retries"),
            (2 + F.col("n_chars") % 20).alias("length"),
            (doc % 3).alias("src_idx"),
            doc.alias("line_no"),
        )
    )


@query(f"""WITH {_RECORDS}, w AS (SELECT *, count(*) OVER k AS n, count(msg_hash) OVER k AS held, min(msg_hash) OVER k AS lo, max(msg_hash) OVER k AS hi,
        row_number() OVER (PARTITION BY _key ORDER BY src_idx, line_no) AS first,
        row_number() OVER (PARTITION BY _key ORDER BY coalesce(judge = 'pass', FALSE)::INT DESC, coalesce(retries, 1000000000), (length BETWEEN 8 AND 16)::INT DESC,
            CASE WHEN length BETWEEN 8 AND 16 THEN 0 ELSE least(abs(length - 8), abs(length - 16)) END, src_idx, line_no) AS best
        FROM r WINDOW k AS (PARTITION BY _key))
    SELECT doc_id, CASE WHEN n = 1 THEN 'clean' WHEN held = n AND lo = hi THEN CASE WHEN first = 1 THEN 'duplicate_kept' ELSE 'duplicate_dropped' END
        WHEN best = 1 THEN 'conflict_selected' ELSE 'conflict_rejected' END AS decision FROM w""")
def key_conflict_resolution(spark, sf_dir):
    return dedup.resolve_keys(_records(spark, sf_dir)).select("doc_id", "decision")


@query(f"""WITH {_RECORDS}, w AS (SELECT *, count(DISTINCT CASE WHEN _key IS NULL THEN 'x' ELSE split_part(_key, '_', 1) END) OVER (PARTITION BY msg_hash) AS qs, count(_key) OVER (PARTITION BY msg_hash) AS keyed,
        count(*) OVER (PARTITION BY msg_hash) AS n, row_number() OVER (PARTITION BY msg_hash ORDER BY src_idx, line_no) AS rn FROM r)
    SELECT doc_id, CASE WHEN msg_hash IS NULL OR (qs = 1 AND keyed = n) OR rn = 1 THEN 'kept' ELSE 'rejected' END AS decision FROM w""")
def content_dedup(spark, sf_dir):
    return dedup.resolve_contents(_records(spark, sf_dir)).select("doc_id", "decision")


_PASSED = "p AS (SELECT (doc_id % 200) || '_' || " + _P + " AS _key, quality AS src_idx, doc_id AS line_no FROM labels)"
#: Questions whose number leaves 7 when divided by 23 have no dialogues of their own.
_DLG = "d AS (SELECT (CASE WHEN doc_id % 250 % 23 = 7 THEN 1000 ELSE 0 END + doc_id % 250) || '_' || " + _P + " AS _key, doc_id AS line_no, source AS topic, lang AS system FROM documents)"


def _passed(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.concat_ws("_", (F.col("doc_id") % 200).cast("string"), _profile()).alias("_key"), F.col("quality").alias("src_idx"), F.col("doc_id").alias("line_no"))


def _dialogues(spark, sf_dir):
    q = F.col("doc_id") % 250
    return _docs(spark, sf_dir).select(F.concat_ws("_", (F.when(q % 23 == 7, 1000).otherwise(0) + q).cast("string"), _profile()).alias("_key"), F.col("doc_id").alias("line_no"), F.col("source").alias("topic"), F.col("lang").alias("system"))


@query(f"""WITH {_PASSED}, {_DLG}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _key ORDER BY line_no) AS rn FROM d) WHERE rn = 1)
    SELECT p._key, p.src_idx, p.line_no, u.line_no AS dialogue_line, u.topic, u.system FROM p JOIN u USING (_key)""")
def merge_first_wins(spark, sf_dir):
    return merge.first_wins(_passed(spark, sf_dir), _dialogues(spark, sf_dir))[0]


@query(f"WITH {_PASSED}, {_DLG} SELECT * FROM p WHERE _key NOT IN (SELECT _key FROM d)")
def merge_missing(spark, sf_dir):
    return merge.first_wins(_passed(spark, sf_dir), _dialogues(spark, sf_dir))[1]


@query(f"""WITH {_PASSED}, {_DLG}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _key ORDER BY line_no DESC) AS rn FROM d) WHERE rn = 1),
    j AS (SELECT p.*, u.line_no AS dialogue_line, u.topic, u.system, row_number() OVER (PARTITION BY p._key, u.line_no IS NULL ORDER BY p.src_idx, p.line_no) AS nth FROM p LEFT JOIN u USING (_key))
    SELECT _key, src_idx, line_no, dialogue_line, topic, system, CASE WHEN dialogue_line IS NULL THEN 'missing' WHEN nth = 1 THEN 'merged' ELSE 'duplicate' END AS outcome FROM j""")
def merge_last_wins(spark, sf_dir):
    return merge.last_wins(_passed(spark, sf_dir), _dialogues(spark, sf_dir))


@query(f"""WITH {_PASSED}, {_DLG}, j AS (SELECT p.*, (p._key IN (SELECT _key FROM d)) AS found, row_number() OVER (PARTITION BY p._key, p._key IN (SELECT _key FROM d) ORDER BY p.src_idx, p.line_no) AS nth FROM p)
    SELECT src_idx, count(*) AS read, count(*) FILTER (found AND nth = 1) AS merged, count(*) FILTER (found AND nth > 1) AS duplicate, count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND nth > 1) AS renamed FROM j GROUP BY src_idx""")
def merge_summary(spark, sf_dir):
    return reports.merge_summary(merge.last_wins(_passed(spark, sf_dir), _dialogues(spark, sf_dir)), F.col("outcome") == "duplicate")


@query(f"""WITH {_PASSED} SELECT src_idx, line_no, repeat('_', (row_number() OVER (PARTITION BY _key ORDER BY src_idx, line_no) - 1)::INT) || _key AS new_key FROM p""")
def collision_rename(spark, sf_dir):
    return merge.renamed(_passed(spark, sf_dir)).select("src_idx", "line_no", "new_key")


_TYPED = """k AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '_' ELSE '' END || doc_id || '_' || """ + _P + " AS _key, " + _P + """ AS profile FROM documents),
    ty AS (SELECT *, CASE WHEN _key LIKE '\\_%' ESCAPE '\\' OR (doc_id % 5 = 0 AND doc_id % 10 <> 0) THEN 'error' ELSE 'normal' END AS sample_type FROM k)"""


def _typed(spark, sf_dir):
    doc = F.col("doc_id")
    keys = _docs(spark, sf_dir).select("doc_id", F.concat(F.when(doc % 13 == 0, "_").otherwise(""), F.concat_ws("_", doc.cast("string"), _profile())).alias("_key"), _profile().alias("profile"))
    return merge.sample_type(keys, keys.where("doc_id % 5 = 0"), keys.where("doc_id % 10 = 0"))


@query(f"WITH {_TYPED} SELECT doc_id, _key, profile, sample_type FROM ty")
def sample_types(spark, sf_dir):
    return _typed(spark, sf_dir).select("doc_id", "_key", "profile", "sample_type")


@query(f"WITH {_TYPED} SELECT profile, sample_type, count(*) AS n, round(count(*) FILTER (sample_type = 'error') * 100.0 / count(*), 4)::DOUBLE AS error_percent FROM ty GROUP BY CUBE (profile, sample_type)")
def split_summary(spark, sf_dir):
    return reports.split_summary(_typed(spark, sf_dir))


@query(f"""WITH {_RECORDS} SELECT count(*) AS records, count(DISTINCT _key) + max((_key IS NULL)::INT) AS unique_keys, count(DISTINCT split_part(_key, '_', 1)) AS questions,
    round(count(_key) / count(DISTINCT split_part(_key, '_', 1)), 4) AS dialogues_per_question FROM r""")
def cleanup_summary(spark, sf_dir):
    return reports.cleanup_summary(_records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT split_part(_key, '_', 2) AS profile, count(*) AS n FROM r WHERE _key IS NOT NULL GROUP BY 1")
def profile_counts(spark, sf_dir):
    return reports.profile_counts(_records(spark, sf_dir))


# candidates, quotas, coverage --------------------------------------------------


@query("SELECT qi, profile, qi || '_' || profile AS _key FROM (SELECT DISTINCT conv_id AS qi FROM conversations), (SELECT unnest(['FAST', 'MEM', 'SLOW']) AS profile) "
       "WHERE qi || '_' || profile NOT IN (SELECT conv_id || '_' || ['FAST', 'MEM', 'SLOW'][(conv_id % 3 + 1)::INT] FROM conversations WHERE conv_id % 2 = 0)")  # fmt: skip
def candidates_todo(spark, sf_dir):
    made = records(spark, sf_dir)
    questions = made.select(F.col("conv_id").alias("qi"))
    return quota.not_done(quota.candidates(questions), made.where("conv_id % 2 = 0")).select("qi", "profile", "_key")


_ORDER = "('0x' || substr(md5('42:' || {0}), 1, 15))::BIGINT"


@query("SELECT conv_id, " + _ORDER.format("conv_id") + " AS ord, row_number() OVER (ORDER BY " + _ORDER.format("conv_id") + ") AS place FROM (SELECT DISTINCT conv_id FROM conversations)")
def seeded_shuffle(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("ord", quota.seeded_order(F.col("conv_id").cast("string"), 42))
    placed = rows.repartitionByRange("ord").withColumn("part", F.spark_partition_id())
    placed = durable(placed)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select("conv_id", "ord", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("ord"))).alias("place"))


@query("""WITH d AS (SELECT DISTINCT conv_id, ['FAST', 'MEM', 'SLOW'][(conv_id % 3 + 1)::INT] AS profile FROM conversations),
    q AS (SELECT profile, CASE profile WHEN 'FAST' THEN 17 WHEN 'MEM' THEN 17 ELSE 16 END - (SELECT count(*) FROM d e WHERE e.profile = p.profile AND e.conv_id % 10 = 0) AS quota FROM (SELECT DISTINCT profile FROM d) p)
    SELECT conv_id, d.profile, row_number() OVER (PARTITION BY d.profile ORDER BY conv_id) <= greatest(quota, 0) AS admitted FROM d JOIN q ON q.profile = d.profile WHERE conv_id % 10 <> 0""")
def quota_admission(spark, sf_dir):
    rows = records(spark, sf_dir).select("conv_id", "profile", F.col("conv_id").alias("ord"))
    return quota.admit(rows.where("conv_id % 10 <> 0"), quota.plan(50), rows.where("conv_id % 10 = 0")).select("conv_id", "profile", "admitted")


_COVER = """made AS (SELECT doc_id % 400 AS qi, list_distinct(list(CASE WHEN doc_id % 17 = 0 THEN 'OTHER' ELSE """ + _P + """ END)) AS m FROM documents GROUP BY 1),
    c AS (SELECT p_partkey AS qi, p_brand AS category, list_filter(['FAST', 'MEM', 'SLOW'], lambda x: NOT list_contains(coalesce(m, []), x)) AS missing, coalesce(m, []) AS m FROM part LEFT JOIN made ON qi = p_partkey),
    cov AS (SELECT qi, category, list_contains(m, 'FAST') AS "FAST", list_contains(m, 'MEM') AS "MEM", list_contains(m, 'SLOW') AS "SLOW", array_to_string(missing, ',') AS missing,
        CASE WHEN len(missing) = 0 THEN 'tam' WHEN len(m) > 0 THEN 'kısmi' ELSE 'üretilmedi' END AS status FROM c)"""


def _coverage(spark, sf_dir):
    questions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qi"), F.col("p_brand").alias("category"))
    made = _docs(spark, sf_dir).select(F.concat_ws("_", (F.col("doc_id") % 400).cast("string"), F.when(F.col("doc_id") % 17 == 0, "OTHER").otherwise(_profile())).alias("_key"))
    return C.coverage(questions, made)


@query(f"WITH {_COVER} SELECT * FROM cov")
def coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {_COVER} SELECT status, count(*) AS n FROM cov GROUP BY status")
def coverage_totals(spark, sf_dir):
    return _coverage(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_COVER}, t AS (SELECT qi AS line_no, status FROM cov WHERE status <> 'tam') SELECT line_no, status, row_number() OVER (ORDER BY status <> 'üretilmedi', line_no) AS place FROM t")
def task_priority(spark, sf_dir):
    tasks = _coverage(spark, sf_dir).where(F.col("status") != C.FULL).select(F.col("qi").alias("line_no"), "status")
    keyed = C.task_order(tasks).withColumn("one", F.col("place.late"))
    late = tasks.where(F.col("status") == C.NONE).agg(F.count(F.lit(1)).alias("early"))
    ranked = quota.ranked(keyed, ["one"], "line_no", "rank").crossJoin(F.broadcast(late))
    return ranked.select("line_no", "status", (F.col("rank") + F.when(F.col("one") == 1, F.col("early")).otherwise(0)).alias("place"))


# splits ------------------------------------------------------------------------


@query(f"""WITH {_TYPED}, o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY {_ORDER.format('_key')}) AS rn, count(*) OVER (PARTITION BY profile) AS n FROM ty)
    SELECT doc_id, profile, CASE WHEN rn <= CASE WHEN n > 1 THEN least(greatest(round_even(n * 0.1, 0)::BIGINT, 1), n - 1) ELSE 1 END THEN 'val' ELSE 'train' END AS split FROM o""")
def stratified_split(spark, sf_dir):
    return split.by_profile(_typed(spark, sf_dir)).select("doc_id", "profile", "split")


@query(f"""WITH {_TYPED}, o AS (SELECT *, row_number() OVER (PARTITION BY profile, sample_type ORDER BY {_ORDER.format('_key')}) AS rn, count(*) OVER (PARTITION BY profile, sample_type) AS n FROM ty)
    SELECT doc_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM o""")
def split_floor(spark, sf_dir):
    return split.by_profile_and_type(_typed(spark, sf_dir)).select("doc_id", "split")


@query(f"""WITH {_TYPED}, s AS (SELECT profile, count(*) AS n FROM ty GROUP BY profile), f AS (SELECT *, ceil(sum(n) OVER () * 0.15::DOUBLE) AS total, sum(n) OVER () AS every FROM s),
    b AS (SELECT *, floor(n * total / every) AS base, n * total / every AS exact FROM f), r AS (SELECT *, row_number() OVER (ORDER BY round(base - exact, 9), profile) AS rk, sum(base) OVER () AS given FROM b)
    SELECT profile, n, (base + CASE WHEN rk <= total - given THEN 1 ELSE 0 END)::BIGINT AS val FROM r""")
def label_split_counts(spark, sf_dir):
    rows = split.by_label(_typed(spark, sf_dir), "profile")
    return rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "val").alias("val"))


_GROUPS = f"""g AS (SELECT doc_id % 121 AS question, {_P} AS profile, CASE WHEN doc_id % 29 = 0 THEN '_' ELSE '' END || (doc_id % 121) || '_' || {_P} AS _key, doc_id FROM documents),
    q AS (SELECT question, array_to_string(list_sort(list_distinct(list(profile))), '') || '|error=' || max(CASE WHEN _key LIKE '\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS bucket FROM g GROUP BY question),
    z AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY {_ORDER.format('question')}) AS rn FROM q),
    y AS (SELECT *, round_even(n * 0.1, 0)::BIGINT AS t, round_even(n * 0.1, 0)::BIGINT AS v FROM z),
    x AS (SELECT *, CASE WHEN t + v >= n AND n >= 3 THEN greatest(0, least(v, n - 1 - t)) ELSE v END AS v2 FROM y),
    sp AS (SELECT question, bucket, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v2 THEN 'val' ELSE 'train' END AS split FROM x)"""


def _groups(spark, sf_dir):
    doc = F.col("doc_id")
    rows = _docs(spark, sf_dir)
    key = F.concat(F.when(doc % 29 == 0, "_").otherwise(""), F.concat_ws("_", (doc % 121).cast("string"), _profile()))
    return split.by_question(rows.select("doc_id", (doc % 121).alias("question"), _profile().alias("profile"), key.alias("_key")))


@query(f"WITH {_GROUPS} SELECT doc_id, g.question, split FROM g JOIN sp ON sp.question = g.question")
def group_split(spark, sf_dir):
    return _groups(spark, sf_dir).select("doc_id", "question", "split")


@query(f"WITH {_GROUPS} SELECT split, count(DISTINCT g.question) AS questions, count(*) AS rows FROM g JOIN sp ON sp.question = g.question GROUP BY split")
def group_split_counts(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("split").agg(F.count_distinct("question").alias("questions"), F.count(F.lit(1)).alias("rows"))


#: A split by profile alone: its questions are in both parts.
_LEAKY = f"""{_TYPED}, o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY {_ORDER.format('_key')}) AS rn, count(*) OVER (PARTITION BY profile) AS n FROM ty),
    sp AS (SELECT doc_id, doc_id % 121 AS question, CASE WHEN rn <= CASE WHEN n > 1 THEN least(greatest(round_even(n * 0.1, 0)::BIGINT, 1), n - 1) ELSE 1 END THEN 'val' ELSE 'train' END AS split FROM o)"""


def _leaky(spark, sf_dir):
    return split.by_profile(_typed(spark, sf_dir)).withColumn("question", F.col("doc_id") % 121)


@query(f"WITH {_LEAKY} SELECT question, count(DISTINCT split) AS splits FROM sp GROUP BY question HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    return split.overlaps(_leaky(spark, sf_dir), "question")


@query(f"WITH {_LEAKY}, w AS (SELECT * FROM sp WHERE split = 'val' OR doc_id % 50 <> 3) SELECT (SELECT count(*) FROM sp) AS read, count(*) AS written, count(*) = (SELECT count(*) FROM sp) AS balanced FROM w")
def reconcile_split(spark, sf_dir):
    rows = _leaky(spark, sf_dir)
    return reports.reconcile(rows, rows.where("split = 'val'"), rows.where("split = 'train' AND doc_id % 50 <> 3"))


# verdicts ----------------------------------------------------------------------

_PICKS = {name: values for name, values in judge.RUBRIC.items()}


def _scores(spark, sf_dir):
    """Rubric scores made of document numbers: a few are out of range."""
    doc = F.col("doc_id")
    entries = []
    for i, (name, values) in enumerate(_PICKS.items()):
        place = F.pmod(F.floor(doc / (i + 1)), F.lit(4 if name == "S8" else 5 if name == "S1" else len(values) + 2))
        value = F.lit(values[0])
        for j, v in enumerate(values):
            value = F.when(place == j, v).otherwise(value)
        if name in ("S2", "S10"):
            value = F.when(doc % 23 == 7, "?").otherwise(value)
        entries += [F.lit(name), value]
    for name, value in (("gerekce", F.when(doc % 19 == 4, " ").otherwise("x")), ("S8_aciklama", F.lit("x")), ("S11_gerekce", F.lit("x")), ("S9a", F.when(doc % 7 == 0, "var").otherwise("yok")), ("S7a", F.lit("yok")), ("confidence", F.when(doc % 31 == 0, "??").otherwise("orta"))):
        entries += [F.lit(name), value]
    return _docs(spark, sf_dir).select("doc_id", _profile().alias("profile"), F.create_map(*entries).alias("scores"))


def _score_sql() -> str:
    columns = []
    for i, (name, values) in enumerate(_PICKS.items()):
        place = f"((doc_id // {i + 1}) % {4 if name == 'S8' else 5 if name == 'S1' else len(values) + 2})"
        pick = "CASE " + place + " " + " ".join(f"WHEN {j} THEN '{v}'" for j, v in enumerate(values)) + f" ELSE '{values[0]}' END"
        if name in ("S2", "S10"):
            pick = f"CASE WHEN doc_id % 23 = 7 THEN '?' ELSE {pick} END"
        columns.append(f"{pick} AS {name}")
    return f"s AS (SELECT doc_id, {_P} AS profile, {', '.join(columns)} FROM documents)"


_RULE = """CASE WHEN S1 IN ('bazen_verdi', 'sıklıkla_verdi') OR S8 = 'ciddi_hata' OR S11 = 'hayır' OR S9 = 'sık_tekrar' OR (S9 = 'bir_kez_tekrar' AND profile <> 'SLOW') OR S_SON = 'yeni_konu_acti' THEN 'fail'
    WHEN S1 = 'hiç_vermedi' AND S5 <> 'takılı_kaldı' AND S8 = 'hata_yok' AND S11 = 'evet' AND S9 = 'hayır' AND S_SON = 'dogru_kapanis' THEN 'pass' ELSE 'review' END"""
_JUDGED = f"{_score_sql()}, v AS (SELECT *, {_RULE} AS verdict FROM s)"


def _judged(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("verdict", judge.rule_verdict(F.col("scores"), F.col("profile")))


@query(f"WITH {_JUDGED} SELECT doc_id, profile, verdict FROM v")
def verdict_rule(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "profile", "verdict")


@query(f"""WITH {_JUDGED} SELECT doc_id, array_to_string(list_filter([CASE WHEN S2 = '?' THEN 'invalid_S2' END, CASE WHEN S10 = '?' THEN 'invalid_S10' END, CASE WHEN doc_id % 19 = 4 THEN 'blank_gerekce' END,
        CASE WHEN doc_id % 41 = 0 THEN 'red_nedenleri_not_list' END, CASE WHEN S4 = 'hayır' AND S4a NOT IN ('geçerli_değil', 'fırsat_olmadı') THEN 'S4_contradicts_S4a' END,
        CASE WHEN S9 = 'hayır' AND doc_id % 7 = 0 THEN 'S9_contradicts_S9a' END, CASE WHEN doc_id % 31 = 0 THEN 'invalid_confidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM v""")
def rubric_validate(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", F.array_join(judge.rubric_errors(F.col("scores"), F.col("doc_id") % 41 != 0), ",").alias("errors"))


@query(f"WITH {_JUDGED}, m AS (SELECT *, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END AS model FROM v LEFT JOIN labels USING (doc_id)) SELECT doc_id, coalesce(model, '?') <> verdict AS disagreement, CASE WHEN coalesce(model, '?') <> verdict THEN coalesce(model, '?') END AS verdict_llm FROM m")
def verdict_override(spark, sf_dir):
    rows = _judged(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    differs, model = judge.overridden(F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail"), F.col("verdict"))
    return rows.select("doc_id", differs.alias("disagreement"), model.alias("verdict_llm"))


@query(f"WITH {_JUDGED} SELECT verdict AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 1)::DOUBLE AS percent FROM v GROUP BY verdict")
def verdict_distribution(spark, sf_dir):
    return judge.distribution(_judged(spark, sf_dir), "verdict")


@query("SELECT coalesce(CASE quality WHEN 1 THEN 'yüksek' WHEN 0 THEN 'düşük' END, '?') AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 1)::DOUBLE AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def confidence_distribution(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return judge.distribution(rows.withColumn("c", F.when(F.col("quality") == 1, "yüksek").when(F.col("quality") == 0, "düşük")), "c")


@query(f"WITH {_JUDGED} SELECT profile, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'review') AS n_review, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) AS total, round(count(*) FILTER (verdict = 'fail') * 100.0 / count(*), 1)::DOUBLE AS fail_rate FROM v GROUP BY profile")
def profile_verdict_crosstab(spark, sf_dir):
    return judge.crosstab(_judged(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id, ['true', '1', 'Evet', 'no', '0', ' YES ', '2.5', 'x', NULL][(doc_id % 9 + 1)::INT] AS a, CASE WHEN doc_id % 2 = 0 THEN 'pass' WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'unsure' END AS model FROM documents),
    w AS (SELECT *, coalesce(coalesce(TRY_CAST(trim(a) AS DOUBLE) <> 0, lower(trim(a)) IN ('true', '1', 'yes', 'evet')), FALSE) AS truth FROM c),
    v AS (SELECT *, CASE WHEN truth THEN 'pass' ELSE 'fail' END AS verdict FROM w)
    SELECT doc_id, truth, verdict, CASE WHEN model IN ('pass', 'fail') AND model <> verdict THEN trim('note | model_verdict_mismatch:' || model || '->' || verdict, ' |') ELSE 'note' END AS note FROM v""")
def criteria_verdict(spark, sf_dir):
    doc = F.col("doc_id")
    values = F.array(*(F.lit(v) for v in ("true", "1", "Evet", "no", "0", " YES ", "2.5", "x", None)))
    rows = _docs(spark, sf_dir).select("doc_id", F.get(values, (doc % 9).cast("int")).alias("a"), F.when(doc % 2 == 0, "pass").when(doc % 3 == 0, "fail").otherwise("unsure").alias("model"))
    verdict, note = judge.criteria_verdict({c: F.col("a") for c in judge.CRITERIA}, F.col("model"), F.lit("note"))
    return rows.select("doc_id", T.lenient_bool(F.col("a")).alias("truth"), verdict.alias("verdict"), note.alias("note"))


#: A critic's and a judge's replies to documents: some are missing, some can't be parsed, and scores are checked.
_STAGED = f"""{_JUDGED}, c AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN '{{}}' END AS critic FROM documents WHERE doc_id % 5 <> 0),
    r AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN '{{}}' END AS reply, CASE WHEN doc_id % 11 = 0 THEN 'bad score; worse' END AS wrong FROM documents WHERE doc_id % 4 <> 0),
    st AS (SELECT v.doc_id, verdict, CASE WHEN c.doc_id IS NULL THEN 'critic_api' WHEN critic IS NULL THEN 'critic_parse' WHEN r.doc_id IS NULL THEN 'verdict_api' WHEN reply IS NULL THEN 'verdict_parse'
        WHEN wrong IS NOT NULL THEN 'schema_validation' ELSE 'done' END AS stage, wrong FROM v LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id))"""


def _staged(spark, sf_dir):
    keys = _judged(spark, sf_dir).select(F.col("doc_id").alias("_key"), "verdict")
    critics = keys.where("_key % 5 <> 0").select("_key", F.when(F.col("_key") % 7 != 0, "{}").alias("body"))
    errors = F.when(F.col("_key") % 11 == 0, F.array(F.lit("bad score"), F.lit("worse"))).otherwise(F.array().cast("array<string>"))
    verdicts = keys.where("_key % 4 <> 0").select("_key", F.when(F.col("_key") % 9 != 0, "{}").alias("body"), errors.alias("errors"))
    return judge.two_stage(keys, critics, verdicts)


@query(f"WITH {_STAGED} SELECT doc_id, stage, CASE WHEN stage = 'schema_validation' THEN wrong END AS error FROM st")
def judge_stages(spark, sf_dir):
    return _staged(spark, sf_dir).select(F.col("_key").alias("doc_id"), "stage", "error")


@query(f"WITH {_STAGED} SELECT stage, count(*) AS n FROM st WHERE stage <> 'done' GROUP BY stage")
def error_stages(spark, sf_dir):
    return judge.top_stages(_staged(spark, sf_dir))


@query(f"""WITH {_JUDGED}, m AS (SELECT v.*, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END AS model, CASE quality WHEN 0 THEN 'düşük' END AS confidence, CASE WHEN doc_id % 3 = 1 THEN 'yüksek' END AS ambiguity FROM v LEFT JOIN labels USING (doc_id))
    SELECT count(*) FILTER (coalesce(model, '?') <> verdict) AS overridden, count(*) FILTER (confidence = 'düşük' AND verdict = 'fail') AS unsure_fails, count(*) FILTER (ambiguity = 'yüksek' AND verdict = 'review') AS ambiguous_reviews FROM m""")
def outcome_report(spark, sf_dir):
    rows = _judged(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    differs, _ = judge.overridden(F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail"), F.col("verdict"))
    return judge.outcome_report(rows.select("verdict", differs.alias("disagreement"), F.when(F.col("quality") == 0, "düşük").alias("confidence"), F.when(F.col("doc_id") % 3 == 1, "yüksek").alias("ambiguity")))


@query(f"WITH {_JUDGED} SELECT doc_id, rpad(upper(verdict), greatest(6, length(verdict))::INT, ' ') || ' | ' || profile || ' | ' || substr(text, 1, 35) AS line FROM v JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)")
def progress_lines(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("doc_id", "verdict", "profile").join(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("topic")), "doc_id")
    return rows.select("doc_id", judge.progress_line(*map(F.col, ("verdict", "profile", "topic"))).alias("line"))


@query(f"""WITH {_JUDGED}, p AS (SELECT doc_id, verdict, CASE WHEN doc_id % 5 = 0 THEN 'profile_hint_missing:' || profile END AS issue, CASE WHEN doc_id % 2 = 0 THEN 'seen' END AS told FROM v)
    SELECT doc_id, CASE WHEN issue IS NOT NULL THEN 'fail' ELSE verdict END AS verdict, CASE WHEN issue IS NULL THEN told ELSE concat_ws(' | ', told, issue) END AS note FROM p""")
def profile_gate(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("issue", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("profile_hint_missing:"), "profile")))
    verdict, note = judge.profile_gate(F.col("verdict"), F.when(F.col("doc_id") % 2 == 0, "seen"), F.col("issue"))
    return rows.select("doc_id", verdict.alias("verdict"), note.alias("note"))


# parsing -----------------------------------------------------------------------

#: Keys of the documents' numbers and languages, some of them marred as their texts' lengths say.
_KEYS = """k AS (SELECT doc_id, repeat('_', (length(text) % 3)::INT) || CASE WHEN length(text) % 5 = 0 THEN 'x' ELSE '' END || doc_id || '_' || CASE WHEN length(text) % 7 = 0 THEN source || '-' WHEN length(text) % 11 = 0 THEN '' ELSE upper(lang) END AS _key FROM documents)"""


@query(rf"""WITH {_KEYS} SELECT doc_id, CASE WHEN regexp_matches(_key, '^\d+_[A-Za-z0-9]+$') THEN split_part(_key, '_', 1) END AS plain_q,
    CASE WHEN regexp_matches(_key, '^_*\d+_[A-Za-z0-9]+$') THEN split_part(ltrim(_key, '_'), '_', 1) END AS prefixed_q, CASE WHEN regexp_matches(_key, '^\d+_[^_]*$') THEN split_part(_key, '_', 2) END AS tail_p FROM k""")
def key_parse(spark, sf_dir):
    n = F.length("text")
    mark, tail = F.when(n % 5 == 0, "x").otherwise(""), F.when(n % 7 == 0, F.concat("source", F.lit("-"))).when(n % 11 == 0, "").otherwise(F.upper("lang"))
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.repeat(F.lit("_"), n % 3), mark, F.col("doc_id").cast("string"), F.lit("_"), tail).alias("_key"))
    key = F.col("_key")
    return rows.select("doc_id", T.key_parts(key)[0].alias("plain_q"), T.key_parts(key, True)[0].alias("prefixed_q"), T.key_tail(key)[1].alias("tail_p"))


#: Replies that hold a document's text as a JSON string, with a brace after it, bare, in talk or in a fence; or the text alone.
_REPLIES = r"""b AS (SELECT doc_id, text, length(text) % 4 AS c, '{"n":' || doc_id || ',"s":"' || replace(replace(text, '\', '\\'), '"', '\"') || '}"}' AS body FROM documents),
    r AS (SELECT doc_id, trim(CASE c WHEN 0 THEN body WHEN 1 THEN 'Sure: ' || body || ' done' WHEN 2 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM b),
    x AS (SELECT doc_id, raw, nullif(regexp_extract(raw, '\{(?:[^{}"\\]|"(?:[^"\\]|\\.)*")*\}', 0, 's'), '') AS object, strpos(raw, '{') AS i, length(raw) - strpos(reverse(raw), '}') + 1 AS j FROM r)"""


@query(f"WITH {_REPLIES} SELECT doc_id, object AS strict, coalesce(object, raw) AS lenient, CASE WHEN strpos(raw, '{{') > 0 AND strpos(raw, '}}') > 0 AND j > i THEN substr(raw, i, j - i + 1) ELSE raw END AS outer_braces FROM x")
def json_extraction(spark, sf_dir):
    c, quoted = F.length("text") % 4, F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.concat(F.lit('{"n":'), F.col("doc_id").cast("string"), F.lit(',"s":"'), quoted, F.lit('}"}'))
    raw = F.when(c == 0, body).when(c == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(c == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", F.btrim(raw, F.lit(" \t\n\x0b\x0c\r")).alias("raw"))
    return rows.select("doc_id", R.json_object("raw").alias("strict"), R.json_object_or_text("raw").alias("lenient"), R.outermost_braces(F.col("raw")).alias("outer_braces"))


#: Replies with a verdict word that the text's length chooses, or the text alone.
_SAID = r"""s AS (SELECT doc_id, CASE WHEN length(text) % 5 = 4 THEN text ELSE text || chr(10) || ['KARAR: ŞÜPHELİ', 'karar:  TEMİZ', 'KARAR: ŞÜPHELI', 'KARAR: BELKİ'][(length(text) % 5 + 1)::INT] || chr(10) || 'GEREKÇE: ' || lang || ' of ' || source || ' ' END AS raw FROM documents),
    w AS (SELECT *, regexp_extract(raw, '(?i)KARAR:\s*(ŞÜPHELİ|TEMİZ|ŞÜPHELI)', 1) AS word, regexp_extract(raw, '(?i)GEREKÇE:\s*(.+)', 1) AS said FROM s)"""


@query(f"WITH {_SAID} SELECT doc_id, word LIKE '%PHE%' AS suspicious, CASE WHEN word = '' THEN 'HATA' WHEN word LIKE '%PHE%' THEN 'ŞÜPHELİ' ELSE 'TEMİZ' END AS verdict, CASE WHEN said <> '' THEN trim(said) WHEN raw <> '' THEN raw ELSE 'Model geçerli bir karar döndürmedi.' END AS reason FROM w WHERE raw IS NOT NULL")
def verdict_reply(spark, sf_dir):
    n = F.length("text")
    word = F.get(F.array(*map(F.lit, ("KARAR: ŞÜPHELİ", "karar:  TEMİZ", "KARAR: ŞÜPHELI", "KARAR: BELKİ"))), n % 5)
    raw = F.when(n % 5 == 4, F.col("text")).otherwise(F.concat("text", F.lit("\n"), word, F.lit("\nGEREKÇE: "), "lang", F.lit(" of "), "source", F.lit(" ")))
    suspicious, verdict, reason = R.verdict_line(F.col("raw"))
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw")).where("raw IS NOT NULL").select("doc_id", suspicious.alias("suspicious"), verdict.alias("verdict"), reason.alias("reason"))


@query(f"SELECT regexp_matches(string_agg(text, ''), '[çğıöşüÇĞİÖŞÜ]') AS found, arg_min(substr(text, 1, 120), doc_id) FILTER (regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]')) AS example FROM documents")
def turkish_witness(spark, sf_dir):
    return reports.turkish_witness(_docs(spark, sf_dir), "text", "doc_id")


_LENGTHS = r"l AS (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents)"


@query(f"WITH {_LENGTHS} SELECT count(n) AS n, min(n)::INT AS least, max(n)::INT AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, count(*) FILTER (n > 500) AS over, round(count(*) FILTER (n > 500) * 100.0 / count(n), 6)::DOUBLE AS over_percent FROM l")
def length_stats(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    return reports.length_statistics(rows, "w", 500)


@query(r"""SELECT page_id, coalesce(nullif(substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 80), ''), 'page') AS name, substr(sha256(url), 1, 10) AS digest, lower(rtrim(trim(url), '/')) AS base FROM pages""")
def safe_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(url, "page").alias("name"), T.short_digest(url).alias("digest"), T.base_url(url).alias("base"))


@query("SELECT user_id, array_to_string(list_distinct_ordered, ',') AS cleaned FROM (SELECT user_id, list_transform(list_sort(list([m, event_type])), lambda x: x[2]) AS list_distinct_ordered FROM (SELECT user_id, event_type, lpad(min(event_id)::VARCHAR, 12, '0') AS m FROM events GROUP BY user_id, event_type) GROUP BY user_id)")
def cleaned_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    padded = F.transform("l", lambda x: F.concat(F.lit(" "), x["event_type"], F.lit(" \t")))
    return rows.select("user_id", F.array_join(T.cleaned_list(F.concat(F.array(F.lit(""), F.lit(" ")), padded)), ",").alias("cleaned"))


@query("""WITH e AS (SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN source END AS declared, CASE WHEN length(text) % 2 = 0 THEN text || ' in JSON' ELSE text END AS message FROM documents)
    SELECT doc_id, CASE WHEN declared IS NOT NULL THEN declared WHEN contains(lower(message), 'json') THEN 'judge_json_parse_error' ELSE 'ValueError' END AS kind FROM e""")
def error_kinds(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).select("doc_id", T.error_kind(F.when(n % 3 == 0, F.col("source")), F.when(n % 2 == 0, F.concat("text", F.lit(" in JSON"))).otherwise(F.col("text")), F.lit("ValueError")).alias("kind"))


#: Lines of a coverage file by what is wrong with them; those of case 5 count up to 79, twice the number of questions.
_LETTERS = """l AS (SELECT doc_id AS line_no, doc_id % 8 AS c, CASE WHEN doc_id % 8 = 5 THEN doc_id % 80 ELSE doc_id % 40 END AS q FROM documents WHERE doc_id % 16 <> 8),
    e AS (SELECT *, CASE c WHEN 1 THEN 'bad_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'missing_fields:missing,qi' WHEN 4 THEN 'missing_not_a_filled_list' WHEN 5 THEN CASE WHEN q >= 40 THEN 'qi_out_of_range' END
        WHEN 6 THEN 'missing_not_a_filled_list' WHEN 7 THEN 'unknown_profile' END AS error, CASE WHEN c = 0 THEN 'MEM' WHEN c = 5 AND q < 40 THEN 'FAST' WHEN c = 7 THEN 'ODD' END AS profile FROM l), dl AS (
    SELECT line_no, CASE WHEN c IN (0, 4, 5, 6, 7) THEN q END AS qi, profile, error,
        CASE WHEN error IS NULL THEN q || '_' || profile ELSE '__invalid__line' || line_no || '__qi' || CASE WHEN c IN (4, 5, 6, 7) THEN q::VARCHAR ELSE 'NA' END || '__profile' || coalesce(profile, 'NA') END AS _key FROM e)"""


@query(f"WITH {_LETTERS} SELECT * FROM dl")
def dead_letters(spark, sf_dir):
    case = F.col("doc_id") % 8
    qi = (F.col("doc_id") % F.when(case == 5, 80).otherwise(40)).cast("string")
    full = lambda status, missing: F.concat(F.lit('{"status":"' + status + '","missing":' + missing + ',"qi":'), qi, F.lit("}"))
    line = (
        F.when(F.col("doc_id") % 16 == 8, full("tam", "[]")).when(case == 0, full("kısmi", '["MEM","MEM"]')).when(case == 1, "{bad")
        .when(case == 2, "[1]").when(case == 3, '{"status":"kısmi"}').when(case == 4, full("kısmi", "[]"))
        .when(case == 5, full("üretilmedi", '["FAST"]')).when(case == 6, full("kısmi", '"x"')).otherwise(full("kısmi", '["ODD"]'))
    )
    return C.dead_letters(_docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), line.alias("value")), 40)


@query(f"WITH {_LETTERS} SELECT line_no, _key, p_brand AS category, p_name AS question FROM dl LEFT JOIN part ON p_partkey = qi AND error IS NULL")
def question_lookup(spark, sf_dir):
    bank = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qi"), F.col("p_brand").alias("category"), F.col("p_name").alias("question"))
    return C.with_questions(dead_letters(spark, sf_dir), bank).select("line_no", "_key", "category", "question")
