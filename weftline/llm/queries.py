"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from weftline.llm import exact_dedup, fingerprints, html_extract, language_id, lm_scoring, mixing, ngram_join, packing, sharding, spelling, substring_dedup, turn_repair, url_filter
from weftline.llm.common import documents

SHARDS = 40


def op1_shards(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


def op2_lm_score(spark, sf_dir):
    good = documents(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir), good)


def op3_language(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op4_extract(spark, sf_dir):
    return html_extract.extract(documents(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_report(documents(spark, sf_dir))


def op6_pack(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), keep_ids=False)


def op7_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.repeat_report(documents(spark, sf_dir))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(documents(spark, sf_dir))


def op10_mix(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


def op11_turn_repair(spark, sf_dir):
    return turn_repair.repair_report(documents(spark, sf_dir, "conversations"))


def op12_url_filter(spark, sf_dir):
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {
    "op1_shards": op1_shards,
    "op2_lm_score": op2_lm_score,
    "op3_language": op3_language,
    "op4_extract": op4_extract,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pack": op6_pack,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_mix": op10_mix,
    "op11_turn_repair": op11_turn_repair,
    "op12_url_filter": op12_url_filter,
    "op13_spelling": op13_spelling,
}

#: CRC-32 of a text's bytes: the table of all bytes, and the fold over a text.
_CRC_TABLE = r"""crc_table AS (
            SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS t
        )"""


def _crc32(key: str) -> str:
    """The SQL of the checksum of the string `key`, where crc_table is at hand."""
    code = f"('0x' || hex(encode({key}))[2 * i + 1:2 * i + 2])::BIGINT"
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_transform(range(octet_length(encode({key}))), lambda i: {code}), "
        "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT))"
    )


ORACLES = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    # the excess above three times a source's size is shared anew, round by round, until no share is above
    "op10_mix": r"""
        WITH RECURSIVE keyed AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(coalesce('=' || source, '') || '/' || coalesce('=' || doc_id, '') || '/' || coalesce(md5(text), '')) AS digest
            FROM documents
        ), s AS (
            SELECT *, ('0x' || digest[1:15])::BIGINT AS k, row_number() OVER (PARTITION BY digest[1:15]) - 1 AS nth FROM keyed
        ), hashed AS (
            SELECT *, CASE WHEN nth = 0 THEN ('0x' || digest[1:12])::BIGINT ELSE ('0x' || md5(k || '/' || nth)[1:12])::BIGINT END AS h FROM s
        ), p AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM s GROUP BY source
        ), share AS (
            SELECT 0 AS round, source, source_size, weight, FALSE AS capped, (SELECT sum(source_size) FROM p)::DOUBLE * weight / (SELECT sum(weight) FROM p) AS target FROM p
            UNION ALL
            SELECT round + 1, source, source_size, weight, over, CASE WHEN over THEN 3.0::DOUBLE * source_size ELSE left_over * weight / free END
            FROM (
                SELECT *, (every - sum(CASE WHEN over THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE AS left_over, sum(CASE WHEN over THEN 0 ELSE weight END) OVER () AS free,
                       bool_or(over AND NOT capped) OVER () AS more
                FROM (SELECT *, capped OR target > 3 * source_size AS over, sum(source_size) OVER () AS every FROM share)
            ) WHERE more
        ), t AS (
            SELECT source, source_size, target FROM share WHERE round = (SELECT max(round) FROM share)
        ), u AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS repeats FROM t
        ), g AS (
            SELECT source, h, sum(size) AS words FROM hashed GROUP BY source, h
        ), c AS (
            SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g
        )
        SELECT d.doc_id, d.size, u.source_size, u.target,
               (d.size * (u.repeats + CASE WHEN c.before + c.words / 2 <= u.target - u.repeats * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM hashed d JOIN u ON d.source IS NOT DISTINCT FROM u.source
        JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
    """,
    # links that are whole addresses or begin at the host's root; a component is walked from its blocked addresses
    "op12_url_filter": r"""
        WITH RECURSIVE rules(name, start, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), p AS (
            SELECT row_number() OVER () AS i, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), q AS (
            SELECT i, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1) AS query
            FROM p
        ), tags AS (
            SELECT i, host, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?:link|meta)\b[^>]*>')) AS tag FROM q
        ), named AS (
            SELECT i, host, trim(replace(CASE
                       WHEN lower(tag[1:5]) = '<link' AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''>]*)', 1)
                       WHEN lower(tag[1:5]) = '<meta' AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>]*)', 1)
                   END, '&amp;', '&')) AS link
            FROM tags
        ), ends AS (
            SELECT i, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, strpos(link, '://') + 3) WHEN starts_with(link, '//') THEN substr(link, 3) ELSE host || link END AS rest
            FROM named WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:/)?/') AND (host <> '' OR link LIKE '%://%')
        ), addressed AS (
            SELECT 'page' AS kind, i, host, path, query FROM q
            UNION ALL
            SELECT 'link', i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1) FROM ends
        ), judged AS (
            SELECT kind, i, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node,
                   (SELECT arg_max(struct_pack(rule := name || start, verdict := verdict), (length(name || start), length(name), verdict = 'allow'))
                    FROM rules r WHERE (a.host = r.name OR ends_with(a.host, '.' || r.name)) AND starts_with(a.path, r.start)) AS d
            FROM addressed a
        ), edges AS (
            SELECT DISTINCT s.node AS x, t.node AS y, s.d.verdict AS vx, t.d.verdict AS vy
            FROM judged s JOIN judged t USING (i) WHERE s.kind = 'page' AND t.kind = 'link' AND s.host <> '' AND t.host <> ''
        ), ways AS (
            SELECT x, y FROM edges UNION SELECT y, x FROM edges
        ), bad(node) AS (
            SELECT x FROM edges WHERE vx = 'block' UNION SELECT y FROM edges WHERE vy = 'block'
            UNION
            SELECT ways.y FROM bad JOIN ways ON ways.x = bad.node
        )
        SELECT q.page_id, j.host, j.path, j.d.rule AS rule,
               coalesce(j.d.verdict, CASE WHEN j.host <> '' AND j.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
               CASE WHEN j.d IS NOT NULL THEN 'rule' WHEN j.host <> '' AND j.node IN (SELECT node FROM bad) THEN 'alias' ELSE 'default' END AS decided_by
        FROM q JOIN judged j USING (i) WHERE j.kind = 'page'
    """,
    # costs to go backwards over turns, then one edit a step forwards
    "op11_turn_repair": rf"""
        WITH RECURSIVE {_CRC_TABLE}, rows_ AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
        ), kinds AS (
            SELECT *, {_crc32('key')} % 20 AS kind FROM rows_, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
        ), faulty AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
                   role[1:1] AS r, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), tally AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
            FROM faulty GROUP BY conv_id
        ), togo AS (
            SELECT conv_id, n + 1 AS i, [0, 10, 5, 0]::BIGINT[] AS c FROM tally
            UNION ALL
            SELECT conv_id, i, [least(b[1], x + 5), least(b[2], x + 5), x, least(b[4], b[3] + 5)]
            FROM (
                SELECT conv_id, i, b, least(b[3], b[4] + 5) AS x
                FROM (
                    SELECT f.conv_id, f.i, list_transform([1, 2, 3, 4], lambda s: least(
                               c[s] + 2,
                               CASE WHEN fault IN ('', 't') THEN c[CASE WHEN s = 3 THEN 4 ELSE 3 END] + 1 + CASE WHEN fault = 't' THEN 5 ELSE 0 END ELSE 999999999 END,
                               CASE WHEN fault IN ('', 't') AND r = 's' AND s = 1 THEN c[2] + CASE WHEN fault = 't' THEN 5 ELSE 0 END
                                    WHEN fault IN ('', 't') AND r = 'u' AND s <> 3 THEN c[3] + CASE WHEN fault = 't' THEN 5 ELSE 0 END
                                    WHEN fault IN ('', 't') AND r = 'a' AND s = 3 THEN c[4] + CASE WHEN fault = 't' THEN 5 ELSE 0 END ELSE 999999999 END)) AS b
                    FROM togo g JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1
                )
            )
        ), walk AS (
            SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS made FROM tally
            UNION ALL
            SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
                   CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE WHEN s = 3 THEN 4 ELSE 3 END END, audit || edit,
                   CASE edit WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text)
                             ELSE list_append(made, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
            FROM (
                SELECT w.conv_id, w.i, s, audit, made, role, text, r,
                       CASE WHEN f.i IS NOT NULL AND a.c[s] + 2 = h.c[s] THEN 'D' WHEN h.c[CASE WHEN s = 3 THEN 4 ELSE 3 END] + 5 = h.c[s] THEN 'I'
                            WHEN f.i IS NOT NULL AND ((r = 's' AND s = 1) OR (r = 'u' AND s <> 3) OR (r = 'a' AND s = 3))
                                 AND a.c[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] + CASE WHEN fault = 't' THEN 5 ELSE 0 END = h.c[s] THEN 'K' ELSE 'R' END AS edit
                FROM walk w JOIN togo h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
                LEFT JOIN togo a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
                LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
                WHERE f.i IS NOT NULL OR s IN (2, 3)
            )
        ), done AS (
            SELECT w.conv_id, audit, made FROM walk w JOIN tally t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = t.n + 1 AND s IN (1, 4)
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(h.c[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN tally t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN togo h ON h.conv_id IS NOT DISTINCT FROM o.conv_id AND h.i = 1
    """,
    # words without one code point: equal at one place, or equal to a whole word
    "op13_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE}, runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), counted AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL
        ), hashed AS (
            SELECT run, k, {_crc32('key')} AS h FROM counted, crc_table
        ), words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5
        ), less AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
        ), near AS (
            SELECT x.word AS a, y.word AS b FROM less x JOIN less y USING (i, rest) WHERE x.word <> y.word
            UNION SELECT less.word, words.word FROM less JOIN words ON words.word = less.rest
            UNION SELECT words.word, less.word FROM less JOIN words ON words.word = less.rest
        ), best AS (
            SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS other, max(w.n) AS most FROM near JOIN words w ON w.word = b GROUP BY a
        ), forms AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
        ), followed AS (
            SELECT word, word AS root FROM forms
            UNION ALL
            SELECT followed.word, forms.form FROM followed JOIN forms ON forms.word = followed.root WHERE forms.form IS NOT NULL
        ), ends AS (
            SELECT followed.word, root FROM followed JOIN forms ON forms.word = root WHERE forms.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
}
