"""Verdict rules on rubric scores and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

#: What each rubric field may hold.
RUBRIC = {
    "S1": ("hiç_vermedi", "bazen_verdi", "sıklıkla_verdi"),
    "S2": ("etkili", "kısmen_etkili", "etkisiz"),
    "S3": ("dengeli", "fazla_ipucu", "az_ipucu"),
    "S4": ("hayır", "evet_ama_gerekli", "evet_ve_gereksiz"),
    "S4a": ("evet", "hayır", "fırsat_olmadı", "geçerli_değil"),
    "S5": ("sürekli_ilerledi", "çoğunlukla_ilerledi", "takılı_kaldı"),
    "S6": ("kendisi_ulaştı", "tutor_yönlendirdi", "tutor_söyledi"),
    "S7": ("tam_uyumlu", "kısmen_uyumlu", "uyumsuz"),
    "S8": ("hata_yok", "küçük_belirsizlik", "ciddi_hata"),
    "S9": ("hayır", "bir_kez_tekrar", "sık_tekrar"),
    "S10": ("doğal", "kabul_edilebilir", "yapay"),
    "S11": ("evet", "kısmen", "hayır"),
    "S_SON": ("dogru_kapanis", "yeni_konu_acti"),
}
OPTIONAL = {"confidence": ("düşük", "orta", "yüksek"), "ambiguity": ("düşük", "orta", "yüksek")}
REQUIRED_TEXT = ("S8_aciklama", "S11_gerekce", "gerekce")
CRITERIA = ("ogrenci_hata_yapti", "tutor_onaylamadi", "ogrenci_fark_etti", "kapanis_dogru", "turkce_kalite")


def _score(scores: Column, field: str) -> Column:
    return F.coalesce(scores[field], F.lit(""))


def rubric_errors(scores: Column, reasons_listed: Column) -> Column:
    """Codes of what is wrong with a map of scores; `reasons_listed`: whether the reject reasons are a list."""
    s = lambda f: _score(scores, f)
    blank = lambda f: T.normalise_space(s(f)).isin("yok", "")
    found = [F.when(~s(f).isin(*allowed), f"invalid_{f}") for f, allowed in RUBRIC.items()]
    found += [F.when(T.normalise_space(s(f)) == "", f"blank_{f}") for f in REQUIRED_TEXT]
    found += [
        F.when(~reasons_listed, "red_nedenleri_not_list"),
        F.when((s("S4") == "hayır") & ~s("S4a").isin("geçerli_değil", "fırsat_olmadı"), "S4_contradicts_S4a"),
        F.when((s("S9") == "hayır") & ~blank("S9a"), "S9_contradicts_S9a"),
        F.when((s("S7") == "tam_uyumlu") & ~blank("S7a"), "S7_contradicts_S7a"),
    ]
    found += [F.when((s(f) != "") & ~s(f).isin(*allowed), f"invalid_{f}") for f, allowed in OPTIONAL.items()]
    return F.array_compact(F.array(*found))


def rule_verdict(scores: Column, profile: Column, exempt: str | None = "SLOW") -> Column:
    """fail if any trigger holds, pass if every condition does, else review.

    A student of the exempt profile may repeat once without failing.
    """
    s = lambda f: _score(scores, f)
    once = s("S9") == "bir_kez_tekrar"
    repeats = (s("S9") == "sık_tekrar") | (once & (F.coalesce(profile, F.lit("")) != exempt) if exempt else once)
    fails = s("S1").isin("bazen_verdi", "sıklıkla_verdi") | (s("S8") == "ciddi_hata") | (s("S11") == "hayır") | repeats | (s("S_SON") == "yeni_konu_acti")
    passes = (
        (s("S1") == "hiç_vermedi") & (s("S5") != "takılı_kaldı") & (s("S8") == "hata_yok")
        & (s("S11") == "evet") & (s("S9") == "hayır") & (s("S_SON") == "dogru_kapanis")
    )
    return F.when(fails, "fail").when(passes, "pass").otherwise("review")


def overridden(model: Column, rule: Column) -> tuple[Column, Column]:
    """(disagreement, the model's verdict where it differs)."""
    differs = F.coalesce(model, F.lit("?")) != rule
    return differs, F.when(differs, F.coalesce(model, F.lit("?")))


def criteria_verdict(criteria: dict[str, Column], model_verdict: Column, note: Column) -> tuple[Column, Column]:
    """(verdict, note) of five lenient yes/no answers; a contrary model verdict is noted."""
    every = F.lit(True)
    for name in CRITERIA:
        every = every & T.lenient_bool(criteria[name])
    verdict, model = F.when(every, "pass").otherwise("fail"), F.lower(T.normalise_space(model_verdict))
    told = T.normalise_space(note)
    mismatch = F.concat(told, F.lit(" | model_verdict_mismatch:"), model, F.lit("->"), verdict)
    return verdict, F.when(model.isin("pass", "fail") & (model != verdict), F.btrim(mismatch, F.lit(" |"))).otherwise(told)


def profile_gate(verdict: Column, note: Column, issue: Column) -> tuple[Column, Column]:
    """(verdict, note): a dialogue that misses its profile fails and says so."""
    return F.when(issue.isNotNull(), "fail").otherwise(verdict), F.when(issue.isNotNull(), F.btrim(F.concat_ws(" | ", note, issue), F.lit(" |"))).otherwise(note)


def distribution(rows: DataFrame, column: str, blank: str = "?") -> DataFrame:
    """value, n and percent (one decimal) of a column; null counts as `blank`."""
    counted = rows.groupBy(F.coalesce(F.col(column), F.lit(blank)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


#: Fixed value: characters of a topic that a line of progress shows.
TOPIC_CHARS = 35


def progress_line(verdict: Column, profile: Column, topic: Column) -> Column:
    """What is told of a finished record: VERDICT | profile | beginning of the topic. Nulls are empty."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    word = F.upper(filled(verdict))
    return F.concat_ws(" | ", F.rpad(word, F.greatest(F.length(word), F.lit(6)), F.lit(" ")), filled(profile), F.substring(filled(topic), 1, TOPIC_CHARS))


def crosstab(rows: DataFrame) -> DataFrame:
    """profile, pass, review, fail, total and the share that fails, from (profile, verdict)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return rows.groupBy("profile").agg(
        n("pass").alias("n_pass"), n("review").alias("n_review"), n("fail").alias("n_fail"), F.count(F.lit(1)).alias("total"),
        F.round(n("fail") * 100.0 / F.count(F.lit(1)), 1).alias("fail_rate"),
    )


def two_stage(records: DataFrame, critics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds critic, reply, error and `stage` to records: done, or where it broke off.

    critics, verdicts: _key, body (the parsed reply, null if it could not be parsed); a missing row
    means that the call itself failed. verdicts also have `errors`, what is wrong with the reply's scores.
    """
    c = critics.select("_key", F.col("body").alias("critic"), F.lit(True).alias("_c"))
    v = verdicts.select("_key", F.col("body").alias("reply"), F.col("errors").alias("_errors"), F.lit(True).alias("_v"))
    stage = (
        F.when(F.col("_c").isNull(), "critic_api")
        .when(F.col("critic").isNull(), "critic_parse")
        .when(F.col("_v").isNull(), "verdict_api")
        .when(F.col("reply").isNull(), "verdict_parse")
        .when(F.size("_errors") > 0, "schema_validation")
        .otherwise("done")
    )
    joined = records.join(c, "_key", "left").join(v, "_key", "left").withColumn("stage", stage)
    told = F.when(F.col("stage") == "schema_validation", F.array_join("_errors", "; "))
    return joined.withColumn("error", told).drop("_c", "_v", "_errors")


def outcome_report(rows: DataFrame) -> DataFrame:
    """One row: how many verdicts were overridden, failed with low confidence, or are open with high ambiguity.

    rows: verdict, disagreement, confidence, ambiguity.
    """
    return rows.agg(
        F.count_if(F.coalesce("disagreement", F.lit(False))).alias("overridden"),
        F.count_if(F.coalesce((F.col("confidence") == "düşük") & (F.col("verdict") == "fail"), F.lit(False))).alias("unsure_fails"),
        F.count_if(F.coalesce((F.col("ambiguity") == "yüksek") & (F.col("verdict") == "review"), F.lit(False))).alias("ambiguous_reviews"),
    )


def top_stages(outcomes: DataFrame) -> DataFrame:
    """stage and n of the failed outcomes (stage; null counts as unknown), most frequent first."""
    failed = outcomes.select(F.coalesce("stage", F.lit("unknown")).alias("stage")).where("stage <> 'done'")
    return failed.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage")
