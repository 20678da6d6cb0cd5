"""Text functions against Python's own behaviour."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import messages as M
from weftline.functions import replies, urls
from weftline.functions import text as T

ODD = ["", "  a  b ", "a\x0bb\x1cc\x1fd\x85e\xa0f", "x y z w v u　t", "​q﻿", "İstanbul ŞÜPHELİ ς Σ", "² ½ ⅷ ño", "你好, dünya!", None]


def spaces(s):
    return re.sub(r"\s+", " ", s or "").strip()


def sanitised(s):
    return spaces(re.sub(r"[^\w\s]", " ", (s or "").lower()))


def test_normalise_and_sanitise(spark):
    rows = spark.createDataFrame([(s,) for s in ODD], "s string").select("s", T.normalise_space(F.col("s")).alias("n"), T.sanitise(F.col("s")).alias("c")).collect()
    for r in rows:
        assert r.n == spaces(r.s)
        assert r.c == sanitised(r.s)


def test_simhash(spark):
    from weftline.operators.dialogues import with_simhash

    texts = ["the quick brown fox jumps", "the quick brown fox jumped over", "", "aaa aaa bbb"]

    def plain(words):
        votes = [0] * 64
        for w in words:
            h = int(hashlib.md5(w.encode()).hexdigest(), 16)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        value = sum(1 << b for b, v in enumerate(votes) if v > 0)
        return value - 2**64 if value >= 2**63 else value

    frame = spark.createDataFrame(list(enumerate(texts)), "k int, s string").withColumn("w", T.tokens(F.col("s")))
    got = {r.k: r.simhash for r in with_simhash(frame, "w").collect()}
    assert got == {k: plain([w for w in s.split() if len(w) >= 3]) for k, s in enumerate(texts)}


def test_predicates_and_names(spark):
    one = spark.createDataFrame([(1,)], "i int")
    ask = lambda *cols: tuple(one.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())
    lit = F.lit
    assert ask(T.is_short(lit(" ab　"), 3), T.is_short(lit("abc"), 3), T.is_short(lit(None), 0)) == (True, False, True)
    assert ask(*(T.lenient_bool(lit(v)) for v in ("EVET", " true", "0", "0.0", "3", "nope", None))) == (True, True, False, False, True, False, False)
    assert ask(T.safe_name(lit("a b/ç.png"), "x"), T.safe_name(lit(""), "x"), T.safe_name(lit("é" * 100), "x", 3)) == ("a_b_.png", "x", "_")
    assert ask(*T.key_parts(lit("__12_FAST"), True), *T.key_parts(lit("_12_FAST"))) == ("12", "FAST", None, None)
    assert ask(T.gives_answer(lit("Doğru  cevap: 4")), T.gives_answer(lit("cevaplar")), T.is_turkish(lit("ağ")), T.is_turkish(lit(None))) == (True, False, True, False)
    assert ask(T.base_url(lit(" HTTPS://A.b/c// ")), T.short_digest(lit("t"))) == ("https://a.b/c", hashlib.sha256(b"t").hexdigest()[:10])


def test_json_objects():
    assert replies.find_json('x {"a": "}{", "b": {"c": 1}} y {') == '{"a": "}{", "b": {"c": 1}}'
    assert replies.find_json('```json\n{"a": "q\\"}"}\n```') == '{"a": "q\\"}"}'
    assert replies.find_json('{"a": "open}') is None and replies.find_json("none") is None and replies.find_json(None) is None
    assert replies.find_json(" none ", lenient=True) == "none" and replies.find_json('t ```json {"a":1}``` u', lenient=True) == '{"a":1}'


def test_verdict_lines(spark):
    raw = ["KARAR: ŞÜPHELİ\nGEREKÇE: sekme", "Karar: temiz", "no line", "karar:\tşüpheli", ""]
    frame = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = [tuple(r) for r in frame.select(*(c.alias(n) for c, n in zip(replies.verdict_line(F.col("raw")), "abc", strict=True))).collect()]
    assert [g[:2] for g in got] == [(True, "ŞÜPHELİ"), (False, "TEMİZ"), (False, "HATA"), (True, "ŞÜPHELİ"), (False, "HATA")]
    assert got[0][2] == "sekme" and got[2][2] == "no line"


def test_allowed_urls(spark):
    cases = {
        "https://a.org/exam": True, "https://A.org:443/exam/": True, "https://a.org/exam/2?x#y": True, "https://a.org/examx": False,
        "https://a.org:8443/exam": False, "http://a.org/exam": False, "chrome://x": False, "about:blank": False, "": False, "nonsense": False,
    }
    frame = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.a for r in frame.select("u", urls.is_allowed(F.col("u"), ["https://a.org/exam/"]).alias("a")).collect()} == cases
    every = spark.createDataFrame([("https://exams.example.org/x",), ("https://a.org",)], "u string")
    assert [r.a for r in every.select(urls.is_allowed(F.col("u"), [], "exams.example.org").alias("a")).collect()] == [True, False]
    assert every.select(urls.is_allowed(F.col("u"), ["https://a.org/"]).alias("a")).collect()[1].a


def test_messages(spark):
    schema = "system string, m array<struct<role:string,content:string>>"
    frame = spark.createDataFrame([("S", [("user", "a"), ("assistant", "b?"), ("user", "c"), ("assistant", "d")]), (None, None)], schema)
    r = frame.select(
        M.with_system(F.col("system"), F.col("m")).alias("w"), M.content_hash(F.col("m")).alias("h"), M.trimmed(F.col("m"), 2)[0].alias("t"),
        M.system_merged(M.with_system(F.col("system"), F.col("m"))).alias("x"), M.chat_text(F.slice("m", 1, 1)).alias("c"),
    ).collect()
    assert [x.role for x in r[0].w] == ["system", "user", "assistant", "user", "assistant"]
    assert r[0].h == hashlib.sha1("\n---\n".join(["user\na", "assistant\nb?", "user\nc", "assistant\nd"]).encode()).hexdigest() and r[1].h is None
    assert [x.content for x in r[0].t] == ["a", "c", "d"] and r[0].x[0].content == "S\n\na" and r[0].c == "<|im_start|>user\na<|im_end|>\n"


def test_keys_that_must_parse(spark):
    fine = spark.createDataFrame([("__7_MEM",)], "k string").select(*T.key_parts_or_fail(F.col("k"))).first()
    assert tuple(fine) == ("7", "MEM")
    with pytest.raises(Exception, match="not a key: x_1"):
        spark.createDataFrame([("x_1",)], "k string").select(*T.key_parts_or_fail(F.col("k"))).collect()


def test_python_gets_a_slice_of_texts_at_a_time(spark):
    """A batch of long texts is worked on by runs of a few megabytes, with the results of the whole."""
    import pyarrow as pa

    from weftline.operators import external

    texts = pa.array(["x" * n if n is not None else None for n in (10, None, 3 << 20, 2 << 20, 9 << 20, 5, 0, 1)])
    seen = []
    got = T.by_slices(texts, lambda part: seen.append([len(t or "") for t in part.to_pylist()]) or pa.array(seen[-1], pa.int64()), pa.int64())
    assert got.to_pylist() == [len(t or "") for t in texts.to_pylist()]
    assert len(seen) > 2 and all(sum(part) <= T.SLICE_BYTES or len(part) == 1 for part in seen)
    assert T.by_slices(texts.slice(0, 0), None, pa.int64()).to_pylist() == []
    rows = spark.createDataFrame([(i, f'{{"n":{i}}} ' + "word other " * (100_000 * (i % 4))) for i in range(12)], "_key long, source_question string").coalesce(1)
    said = rows.select("_key", replies.json_object("source_question").alias("j"), T.simhash64_text(F.col("source_question")).alias("h")).collect()
    alone = {r["_key"]: r["h"] for r in rows.repartition(12).select("_key", T.simhash64_text(F.col("source_question")).alias("h")).collect()}
    assert {r["_key"]: (r["j"], r["h"]) for r in said} == {i: (f'{{"n":{i}}}', alone[i]) for i in range(12)}
    talks = external.simulate(rows, lambda q, said: f"{len(q)}", lambda q, said: f"{len(said)}", 1).collect()
    assert [(r["_key"], [m["content"] for m in r["messages"]], len(r["attempts"]), r["error"]) for r in talks] == [(r["_key"], [str(len(r["source_question"])), "1"], 2, None) for r in rows.collect()]
