"""Candidates, resumption and quotas of dialogue production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import messages as M
from weftline.functions import text as T
from weftline.operators import dedup, ranges
from weftline.operators.dialogues import PROFILES

#: Least turns and sampling temperatures by profile and difficulty, with defaults.
MIN_TURNS = {
    "FAST": {"Level 1": 3, "Level 2": 4, "Level 3": 5},
    "MEM": {"Level 1": 4, "Level 2": 5, "Level 3": 6},
    "SLOW": {"Level 1": 5, "Level 2": 6, "Level 3": 7},
}
DEFAULT_MIN_TURNS = {"FAST": 4, "MEM": 5, "SLOW": 6}
TEMPERATURES = {
    "FAST": {"Level 1": 0.2, "Level 2": 0.2, "Level 3": 0.25},
    "MEM": {"Level 1": 0.2, "Level 2": 0.2, "Level 3": 0.25},
    "SLOW": {"Level 1": 0.3, "Level 2": 0.3, "Level 3": 0.5},
}
DEFAULT_TEMPERATURES = {"FAST": 0.2, "MEM": 0.2, "SLOW": 0.3}


def lookup(profile: Column, level: Column, table: dict, defaults: dict, last) -> Column:
    """table[profile][level], else the profile's default, else `last`."""
    found = F.lit(last)
    for name, value in defaults.items():
        found = F.when(profile == name, value).otherwise(found)
    for name, levels in table.items():
        for step, value in levels.items():
            found = F.when((profile == name) & (level == step), value).otherwise(found)
    return found


def min_turns(profile: Column, level: Column) -> Column:
    return lookup(profile, level, MIN_TURNS, DEFAULT_MIN_TURNS, 4)


def temperature(profile: Column, level: Column) -> Column:
    return lookup(profile, level, TEMPERATURES, DEFAULT_TEMPERATURES, 0.3)


def candidates(questions: DataFrame, profiles: tuple[str, ...] = PROFILES, first: int = 0, most: int | None = None) -> DataFrame:
    """A row per question (qi) and profile with its key; qi from `first`, at most `most` questions."""
    some = questions.where(F.col("qi") >= first)
    if most is not None:
        some = some.where(F.col("qi") < first + most)
    return some.withColumn("profile", F.explode(F.array(*map(F.lit, profiles)))).withColumn("_key", F.concat_ws("_", F.col("qi").cast("string"), "profile"))


def not_done(rows: DataFrame, *done: DataFrame) -> DataFrame:
    """The rows whose key none of the done tables has."""
    for table in done:
        rows = rows.join(table.select("_key").distinct(), "_key", "left_anti")
    return rows


def seeded_order(key: Column, seed: int) -> Column:
    """What to sort by for a shuffle that reruns alike: 60 bits of a digest of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 15), 16, 10).cast("long")


def plan(target: int, profiles: tuple[str, ...] = PROFILES) -> dict[str, int]:
    """The target in near equal parts; the first profiles get the remainder."""
    share, rest = divmod(target, len(profiles))
    return {p: share + (i < rest) for i, p in enumerate(profiles)}


def admit(rows: DataFrame, quotas: dict[str, int], existing: DataFrame | None = None) -> DataFrame:
    """Adds `admitted` to rows of (profile, ord): in order, while the profile's quota lasts.

    Rows that exist already count. Ranking by a few profiles would meet in a few tasks, so rows are
    numbered in cells of the order's hash range first: counts by profile and cell give the cell in which
    a quota ends, and only that cell is ranked.
    """
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("profile") == name, n).otherwise(quota)
    rows = rows.withColumn("_quota", quota)
    if existing is not None:
        held = existing.groupBy("profile").agg(F.count(F.lit(1)).alias("_held"))
        rows = rows.join(held, "profile", "left").withColumn("_quota", F.greatest(F.col("_quota") - F.coalesce("_held", F.lit(0)), F.lit(0))).drop("_held")
    return ranked_upto(rows, ["profile"], "ord", "_quota", "admitted").drop("_quota")


def ranked(rows: DataFrame, group: list[str], order: str, out: str, cells: int = 256) -> DataFrame:
    """Adds the row's place, from 1, in its group by the long column `order`.

    Few large groups don't meet in few tasks: the orders are cut into `cells` ranges that hold about as many rows each.
    """
    span = Window.partitionBy(*group)
    celled = rows.withColumn("_cell", F.coalesce(ranges.cell(F.col(order), ranges.edges(rows, F.col(order), cells)), F.lit(-1)))
    counts = celled.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*group, "_cell", F.coalesce(F.sum("_n").over(span.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(order))
    return celled.join(before, [*group, "_cell"]).withColumn(out, F.col("_before") + rank).drop("_cell", "_before")


def ranked_upto(rows: DataFrame, group: list[str], order: str, limit: str, out: str, cells: int = 256) -> DataFrame:
    """Adds the boolean `out`: whether the row is among the first `limit` of its group by the long column `order`."""
    return ranked(rows, group, order, "_rank", cells).withColumn(out, F.col("_rank") <= F.col(limit)).drop("_rank")


def bootstrap(passed: DataFrame, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """profile, ord, simhash, fingerprint of earlier passed records (profile, messages) that new ones are compared with.

    Only records of known profiles that have messages count. Orders are negative: before all new ones.
    """
    profile = F.btrim("profile")
    usable = passed.where(profile.isin(*profiles) & (F.size("messages") > 0))
    return usable.select(
        profile.alias("profile"), (F.monotonically_increasing_id() - F.lit(2**62)).alias("ord"),
        T.simhash64_text(M.joined(F.col("messages"))).alias("simhash"), M.fingerprint(F.col("messages")).alias("fingerprint"),
    )


def _noted(note: Column, more: Column) -> Column:
    return F.when(more.isNull(), note).otherwise(F.btrim(F.concat(T.normalise_space(note), F.lit(" | "), more), F.lit(" |")))


def finished(candidates: DataFrame, quotas: dict[str, int], store, passed: DataFrame | None = None, distance: int = 4, strict: bool = True) -> DataFrame:
    """What becomes of judged candidates (profile, ord, messages, verdict, note, compliant), all of it in one plan.

    In order, a candidate that repeats an earlier one of its profile fails, whatever became of the earlier
    one; so does, if `strict`, one that does not comply with its profile. Those that still pass fill their
    profile's quota, counting the `passed` records of earlier runs; what comes after is told quota_reached.
    Adds duplicate_reason, duplicate_distance, outcome (passed, failed) and the completed verdict and note.
    """
    rows = candidates.withColumns({"simhash": T.simhash64_text(M.joined(F.col("messages"))), "fingerprint": M.fingerprint(F.col("messages"))})
    rows = store(rows)
    before = None if passed is None else store(bootstrap(passed))
    found = dedup.greedy(rows.select("profile", "ord", "simhash", "fingerprint"), store, distance, before)
    reason = F.when(F.col("status") == "exact_duplicate", "exact_duplicate").when(F.col("status") == "near_duplicate", f"near_duplicate_hamming_le_{distance}")
    joined = rows.join(found, ["profile", "ord"]).withColumn("duplicate_reason", reason)
    wrong = F.lit(strict) & ~F.coalesce("compliant", F.lit(True))
    note = _noted(_noted(F.coalesce("note", F.lit("")), F.when(wrong, "profile_noncompliant")), F.col("duplicate_reason"))
    verdict = F.when(wrong | F.col("duplicate_reason").isNotNull(), "fail").otherwise(F.col("verdict"))
    judged = store(joined.withColumns({"verdict": verdict, "note": note, "duplicate_distance": F.when(F.col("status") == "near_duplicate", F.col("distance"))}))
    passes = F.coalesce(F.col("verdict") == "pass", F.lit(False))
    placed = admit(judged.where(passes), quotas, passed)
    full = _noted(F.col("note"), F.when(~F.col("admitted"), "quota_reached"))
    placed = placed.withColumns({"note": full, "outcome": F.when(F.col("admitted"), "passed").otherwise("failed")}).drop("admitted")
    return placed.unionByName(judged.where(~passes).withColumn("outcome", F.lit("failed"))).drop("simhash", "fingerprint", "status", "distance")
