"""Queries on conversations as dialogue records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import messages as M
from weftline.functions import text as T
from weftline.operators import dialogues as D
from weftline.operators import quota as Q
from weftline.operators import validate as V
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


#: The turns of each conversation with their place, from 0, and number.
TURNS = "t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
#: Turns without a leading system turn, which becomes a column.
BODY = (
    TURNS + ", b AS (SELECT conv_id, role, text, i - s AS i, n - s AS n, sys FROM (SELECT *, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s, "
    "max(CASE WHEN i = 0 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM t) WHERE i >= s)"
)
PROFILE = "['FAST', 'MEM', 'SLOW'][(conv_id % 3 + 1)::INT]"
NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SAN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
NORM_TEXT, SAN_TEXT = NORM.format("text"), SAN.format("text")


def records(spark, sf_dir):
    return D.from_turns(table(spark, sf_dir, "conversations"))


def _qc(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("conv_id", V.chatml_reasons(M.with_system(F.col("system"), F.col("messages"))).alias("r"))


_EXPECTED = "CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END"
_QC_SQL = (
    "WITH " + TURNS + f""", s AS (
        SELECT conv_id, any_value(n) AS n,
               max(CASE WHEN i = 0 THEN role END) AS r0, max(CASE WHEN i = 1 THEN role END) AS r1, max(CASE WHEN i = n - 1 THEN role END) AS rl,
               min(CASE WHEN i > 0 AND role <> {_EXPECTED} THEN i END) AS stop
        FROM t GROUP BY conv_id
    ), q AS (
        SELECT conv_id, CASE WHEN n < 3 THEN ['invalid_chatml_messages'] ELSE list_filter([
            CASE WHEN r0 <> 'system' THEN 'first_not_system' END, CASE WHEN r1 <> 'user' THEN 'second_not_user' END,
            CASE WHEN rl <> 'assistant' THEN 'last_not_assistant' END, CASE WHEN r0 <> 'system' THEN 'system_role_invalid' END,
            CASE WHEN stop IS NOT NULL THEN 'not_alternating_' || stop END], lambda x: x IS NOT NULL) END AS r
        FROM s
    ) """
)


@query(_QC_SQL + "SELECT conv_id, CASE WHEN len(r) = 0 THEN 'clean' ELSE 'rejected' END AS status, array_to_string(r, ',') AS reasons FROM q")
def chatml_qc(spark, sf_dir):
    rows = _qc(spark, sf_dir)
    return rows.select("conv_id", F.when(F.size("r") == 0, "clean").otherwise("rejected").alias("status"), F.array_join("r", ",").alias("reasons"))


@query(_QC_SQL + "SELECT reason, count(*) AS n FROM (SELECT DISTINCT conv_id, unnest(r) AS reason FROM q) GROUP BY reason")
def chatml_reason_hist(spark, sf_dir):
    return V.histogram(_qc(spark, sf_dir), "r")


@query(
    "WITH " + BODY + """, r AS (
        SELECT conv_id, list(CASE WHEN role NOT IN ('user', 'assistant') THEN 'invalid_role_' || i END ORDER BY i) AS per, any_value(sys) AS sys, any_value(n) AS n FROM b GROUP BY conv_id
    ) SELECT conv_id, array_to_string(list_filter(list_concat(
        [CASE WHEN sys IS NULL OR trim(sys) = '' THEN 'invalid_system' END, CASE WHEN n < 2 THEN 'invalid_messages_list' END],
        CASE WHEN n < 2 THEN [] ELSE per END), lambda x: x IS NOT NULL), ',') AS reasons FROM r"""
)
def raw_validate(spark, sf_dir):
    rows = records(spark, sf_dir)
    found = V.raw_reasons(F.col("messages"), F.col("system"), F.col("_key"), F.col("profile"))
    return rows.select("conv_id", F.array_join(found, ",").alias("reasons"))


@query("WITH " + BODY + """ SELECT reason, count(*) AS n FROM (
        SELECT CASE WHEN role NOT IN ('user', 'assistant') THEN 'invalid_role_' || i END AS reason FROM b WHERE n >= 2
        UNION ALL SELECT 'invalid_system' FROM b WHERE i = 0 AND (sys IS NULL OR trim(sys) = '')
        UNION ALL SELECT 'invalid_messages_list' FROM b WHERE i = 0 AND n < 2
    ) WHERE reason IS NOT NULL GROUP BY reason""")
def raw_issue_counts(spark, sf_dir):
    rows = records(spark, sf_dir)
    return V.histogram(rows.select(V.raw_reasons(F.col("messages"), F.col("system"), F.col("_key"), F.col("profile")).alias("reasons")), distinct=False)


@query(
    "WITH " + TURNS + f""", s AS (
        SELECT conv_id, max(CASE WHEN i = 0 THEN role END) AS r0, coalesce(max(CASE WHEN i = 1 THEN role END), '') AS r1, max(CASE WHEN i = n - 1 THEN role END) AS rl,
               min(CASE WHEN trim(text) = '' OR (i > 0 AND role <> {_EXPECTED}) THEN i END) AS stop, min(CASE WHEN trim(text) = '' THEN i END) AS blank
        FROM t GROUP BY conv_id
    ) SELECT conv_id, array_to_string(list_filter([
        CASE WHEN r0 <> 'system' THEN 'no_system_prefix' END, CASE WHEN r1 <> 'user' THEN 'first_after_system_not_user' END,
        CASE WHEN stop = blank THEN 'empty_content' END, CASE WHEN stop IS NOT NULL AND (blank IS NULL OR stop <> blank) THEN 'role_not_alternating' END,
        CASE WHEN rl <> 'assistant' THEN 'last_not_assistant' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""
)
def structure_qc(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("conv_id", F.array_join(V.structure_reasons(M.with_system(F.col("system"), F.col("messages"))), ",").alias("reasons"))


_LEVEL = "('Level ' || (conv_id % 4 + 1))"
_MIN_TURNS = "CASE profile WHEN 'FAST' THEN CASE level WHEN 'Level 1' THEN 3 WHEN 'Level 2' THEN 4 WHEN 'Level 3' THEN 5 ELSE 4 END WHEN 'MEM' THEN CASE level WHEN 'Level 1' THEN 4 WHEN 'Level 2' THEN 5 WHEN 'Level 3' THEN 6 ELSE 5 END ELSE CASE level WHEN 'Level 1' THEN 5 WHEN 'Level 2' THEN 6 WHEN 'Level 3' THEN 7 ELSE 6 END END"
_TEMPERATURE = "CASE profile WHEN 'SLOW' THEN CASE level WHEN 'Level 3' THEN 0.5 ELSE 0.3 END ELSE CASE level WHEN 'Level 3' THEN 0.25 ELSE 0.2 END END"


def _level():
    return F.concat(F.lit("Level "), (F.col("conv_id") % 4 + 1).cast("string"))


@query(
    "WITH " + BODY + f""", c AS (SELECT *, {PROFILE} AS profile, {_LEVEL} AS level FROM b), g AS (
        SELECT conv_id, any_value(n) AS n, any_value({_MIN_TURNS}) AS least,
               list('empty_content_' || (i + 1) ORDER BY i) FILTER (trim(text) IN ('', '...')) AS e,
               max(CASE WHEN i = 0 THEN role END) AS r0, max(CASE WHEN i = n - 1 THEN role END) AS rl,
               list('unexpected_role_' || (i + 1) ORDER BY i) FILTER (role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS u,
               list('no_question_' || (i + 1) ORDER BY i) FILTER (role = 'assistant' AND i < n - 1 AND NOT contains(text, '?')) AS q
        FROM c GROUP BY conv_id
    ) SELECT conv_id, array_to_string(list_filter(list_concat(coalesce(e, []), [CASE WHEN r0 <> 'user' THEN 'first_not_user' END, CASE WHEN rl <> 'assistant' THEN 'last_not_assistant' END],
        coalesce(u, []), [CASE WHEN n // 2 < least THEN 'too_few_turns' END], coalesce(q, [])), lambda x: x IS NOT NULL), ',') AS issues FROM g"""
)
def generation_issues(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("conv_id", F.array_join(V.generation_issues(F.col("messages"), Q.min_turns(F.col("profile"), _level())), ",").alias("issues"))


@query(f"SELECT conv_id, profile, level, ({_MIN_TURNS})::INT AS min_turns, ({_TEMPERATURE})::DOUBLE AS temperature FROM (SELECT DISTINCT conv_id, {PROFILE} AS profile, {_LEVEL} AS level FROM conversations)")
def turn_parameters(spark, sf_dir):
    rows = records(spark, sf_dir).select("conv_id", "profile", _level().alias("level"))
    return rows.select("*", Q.min_turns(F.col("profile"), F.col("level")).alias("min_turns"), Q.temperature(F.col("profile"), F.col("level")).alias("temperature"))


@query("WITH " + BODY + f" SELECT conv_id, sha1(string_agg({NORM.format('role')} || chr(10) || {NORM_TEXT}, chr(10) || '---' || chr(10) ORDER BY i)) AS msg_hash FROM b GROUP BY conv_id")
def dialog_hash(spark, sf_dir):
    return records(spark, sf_dir).select("conv_id", M.content_hash(F.col("messages")).alias("msg_hash"))


@query("WITH " + BODY + f" SELECT conv_id, sha1(string_agg(role || '::' || {SAN_TEXT}, '||' ORDER BY i)) AS fingerprint FROM b GROUP BY conv_id")
def dialog_fingerprint(spark, sf_dir):
    return records(spark, sf_dir).select("conv_id", M.fingerprint(F.col("messages")).alias("fingerprint"))


@query("WITH " + BODY + """ SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN '[Öğrenci] ' ELSE '[Tutor] ' END || text, chr(10) ORDER BY i)) AS plain,
        md5(string_agg(CASE role WHEN 'user' THEN '[Öğrenci]: ' WHEN 'assistant' THEN '[Tutor]: ' ELSE '[Unknown]: ' END || text, chr(10) || chr(10) ORDER BY i)) AS spaced FROM b GROUP BY conv_id""")
def dialog_render(spark, sf_dir):
    return records(spark, sf_dir).select("conv_id", F.md5(M.render(F.col("messages"))).alias("plain"), F.md5(M.render(F.col("messages"), colon=True)).alias("spaced"))


@query("WITH " + TURNS + " SELECT conv_id, string_agg(role, ',' ORDER BY i) AS roles, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i)) AS chat FROM t GROUP BY conv_id")
def role_remap(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("m", M.with_system(F.col("system"), F.col("messages")))
    shared = F.transform("m", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("role"), x["content"].alias("content")))
    back = rows.select("conv_id", M.remapped(shared).alias("m"))
    return back.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.md5(M.chat_text(F.col("m"))).alias("chat"))


@query("WITH " + BODY + """, f AS (SELECT *, min(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id) AS u FROM b)
    SELECT conv_id, md5(string_agg(role || ':' || CASE WHEN i = u AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || text ELSE text END, '|' ORDER BY i)) AS merged FROM f GROUP BY conv_id""")
def system_merge(spark, sf_dir):
    rows = records(spark, sf_dir).select("conv_id", M.system_merged(M.with_system(F.col("system"), F.col("messages"))).alias("m"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("merged"))


@query("WITH " + TURNS + " SELECT conv_id, count(*) FILTER (i = 0 OR i >= n - 3 OR n <= 4) AS kept, any_value(n) > 4 AS trimmed, md5(string_agg(text, '|' ORDER BY i) FILTER (i = 0 OR i >= n - 3 OR n <= 4)) AS digest FROM t GROUP BY conv_id")
def history_trim(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("m", M.with_system(F.col("system"), F.col("messages")))
    cut, flag = M.trimmed(F.col("m"), 3)
    return rows.select("conv_id", F.size(cut).cast("long").alias("kept"), flag.alias("trimmed"), F.md5(F.array_join(F.transform(cut, lambda x: x["content"]), "|")).alias("digest"))


@query("WITH " + BODY + f" SELECT conv_id, any_value({PROFILE}) AS profile, any_value(sys) AS system, count(*) AS n_messages FROM b GROUP BY conv_id")
def minimal_projection(spark, sf_dir):
    return D.minimal(records(spark, sf_dir)).select(F.regexp_extract("_key", r"^(\d+)_", 1).cast("long").alias("conv_id"), "profile", "system", F.size("messages").cast("long").alias("n_messages"))


@query("WITH " + TURNS + " SELECT conv_id, count(*) AS n_messages, max(CASE WHEN i = 0 THEN role END) AS first_role, md5(string_agg(text, '|' ORDER BY i)) AS digest FROM t GROUP BY conv_id")
def sft_projection(spark, sf_dir):
    rows = D.sft_rows(records(spark, sf_dir))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.col("messages")[0]["role"].alias("first_role"), F.md5(F.array_join(F.transform("messages", lambda x: x["content"]), "|")).alias("digest"))


@query(f"""WITH {BODY}, s AS (SELECT conv_id, any_value({PROFILE}) AS profile, {SAN.format("string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY i)")} AS said FROM b GROUP BY conv_id)
    SELECT conv_id, CASE profile WHEN 'FAST' THEN CASE WHEN regexp_matches(said, 'bence|mantikli|haklisin|aslinda') THEN NULL ELSE 'profile_hint_missing:FAST' END
        WHEN 'MEM' THEN CASE WHEN regexp_matches(said, 'tanim|emin degilim') THEN NULL ELSE 'profile_hint_missing:MEM' END
        ELSE CASE WHEN regexp_matches(said, 'sanirim|adim adim|bir dakika|tekrar bakayim|emin degilim') THEN NULL ELSE 'profile_hint_missing:SLOW' END END AS issue FROM s""")
def profile_compliance(spark, sf_dir):
    return records(spark, sf_dir).select("conv_id", M.profile_issue(F.col("profile"), F.col("messages")).alias("issue"))


@query(f"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 40 THEN 'short_or_empty' WHEN role = 'assistant' AND NOT contains(text, '?') AND NOT (turn >= 5 AND turn >= 3) THEN 'no_question'
        WHEN role = 'assistant' AND regexp_matches({SAN_TEXT}, 'cevap şu|cevap su|doğru cevap|dogru cevap|nihai cevap') THEN 'direct_answer' END AS flag FROM conversations""")
def reply_gates(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", V.reply_flags(F.col("text"), F.col("role"), F.col("turn"), F.lit(5), F.lit(3), least=40).alias("flag"))


#: Each conversation's turns as one attempt at a reply, and every fifth turn as a second attempt at the one before.
_TRIES = f"""WITH a AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN turn - 1 ELSE turn END AS turn, CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS attempt, turn % 3 = 0 AS tutor, text FROM conversations),
    r AS (SELECT *, length(trim(text)) < 40 AS short, tutor AND NOT contains(text, '?') AND NOT turn = 5 AS mute, tutor AND NOT contains(text, '?') AND turn = 5 AS closing,
        tutor AND regexp_matches({SAN_TEXT}, 'cevap şu|cevap su|doğru cevap|dogru cevap|nihai cevap') AS told FROM a),
    w AS (SELECT *, short OR mute OR told AS bad, concat_ws(',', CASE WHEN short THEN 'short_or_empty' END, CASE WHEN mute THEN 'no_question' END, CASE WHEN told THEN 'direct_answer' END) AS why FROM r),
    g AS (SELECT conv_id, turn, tutor, bool_and(bad) AS lost, arg_max(why, attempt) AS why FROM w GROUP BY conv_id, turn, tutor)"""


@query(f"""{_TRIES}, l AS (SELECT conv_id, arg_min(CASE WHEN tutor THEN 'tutor' ELSE 'student' END || '_reply_quality_error: ' || why, (turn, tutor)) AS error FROM g WHERE lost GROUP BY conv_id)
    SELECT conv_id, count(*) FILTER (bad AND NOT tutor) AS student_retry_count, count(*) FILTER (bad AND tutor) AS tutor_retry_count, count(*) FILTER (short) AS short_or_empty_reply_detected,
        count(*) FILTER (mute) AS tutor_no_question_detected, count(*) FILTER (told) AS tutor_direct_answer_detected, count(*) FILTER (closing) AS tutor_closing_without_question, any_value(l.error) AS error
    FROM w LEFT JOIN l USING (conv_id) GROUP BY conv_id""")
def reply_qc(spark, sf_dir):
    turn = F.col("turn")
    attempts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("_key"), F.when(turn % 5 == 4, turn - 1).otherwise(turn).alias("turn"), F.when(turn % 5 == 4, 1).otherwise(0).alias("attempt"),
        F.when(turn % 3 == 0, "assistant").otherwise("user").alias("role"), F.col("text").alias("reply"), F.lit(5).alias("max_turns"), F.lit(3).alias("min_turns"),
    )
    return V.qc_flags(attempts, least=40).withColumnRenamed("_key", "conv_id")


@query(f"SELECT conv_id, turn, (text IS NOT NULL AND trim(text) <> '') AS filled, contains(text, '?') AS asks, regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') AS turkish, regexp_matches({SAN_TEXT}, 'cevap şu|cevap su|doğru cevap|dogru cevap|nihai cevap') AS leaks FROM conversations")
def text_predicates(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_filled(text).alias("filled"), T.asks(text).alias("asks"), T.is_turkish(text).alias("turkish"), T.gives_answer(text).alias("leaks"))
