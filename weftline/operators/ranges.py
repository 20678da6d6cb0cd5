"""Cells of about equal numbers of rows along a time axis, whatever its clusters, and heavy keys apart from the rest."""

from __future__ import annotations

from bisect import bisect_left
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells at most, and rows of a key beyond which it is heavy, or a share of all rows if that is more.
MOST_CELLS = 1024
LEAST_HEAVY = 1000
HEAVY_SHARE = 1 / 5000


def edges(rows: DataFrame, at: Column, cells: int | None = None) -> list[int]:
    """The numbers that cut the rows' values `at` (long) into cells of about equal size; a value that fills cells by itself is repeated.

    They come from one pass that keeps a summary of quantiles.
    """
    n = min(cells or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_CELLS)
    if n < 2:
        return []
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    found = rows.agg(F.percentile_approx(at, shares, F.lit(20 * n)).alias("e")).first()[0]
    return [int(e) for e in found or ()]


def cell(at: Column, cuts: list[int]) -> Column:
    """How many of the different cuts are not above the value: first among groups of cuts, then within one."""
    unique = sorted(set(cuts))
    if not unique:
        return F.when(at.isNotNull(), F.lit(0))
    size = max(1, isqrt(len(unique)))
    groups = [unique[i : i + size] for i in range(0, len(unique), size)]
    table = F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) for g in groups))
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    group = F.size(F.filter(heads, lambda c: c <= at))
    inside = F.size(F.filter(F.get(table, F.greatest(group - 1, F.lit(0))), lambda c: c <= at))
    return F.when(at.isNotNull(), F.when(group == 0, 0).otherwise((group - 1) * size + inside))


def crowded(cuts: list[int]) -> dict[int, int]:
    """Values that are cuts several times, with how many cells they fill."""
    times: dict[int, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    return {c: n for c, n in times.items() if n > 1}


def dealt(at: Column, cuts: list[int], by: Column) -> Column:
    """0, or for the rows of a crowded value one of the numbers from 1 to its cells and one more, by a hash of `by`: cells besides that of its range."""
    sub = F.lit(0)
    for value, n in crowded(cuts).items():
        sub = F.when(at == value, F.pmod(F.xxhash64(by), F.lit(n + 1)).cast("int") + 1).otherwise(sub)
    return sub


def position(value: int, cuts: list[int]) -> int:
    """The cell that begins with the cut `value`."""
    return bisect_left(sorted(set(cuts)), value) + 1


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of `rows` with a table of one row per key, cheap to read twice, whose column `weight` says how many rows have the key.

    Heavy keys, fewer than 1 / HEAVY_SHARE whatever the data, are broadcast, so that no key's rows meet in one task; the
    others are joined by shuffling. Null keys are keys too.
    """
    total, most = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(LEAST_HEAVY, int(total * HEAVY_SHARE))
    other = keyed.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in keyed.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    names = [f"_on_{c}" for c in on]
    if most <= limit:
        return rows.join(other, same).drop(*names)
    heavy = other.where(F.col(weight) > limit)
    hot = rows.join(F.broadcast(heavy), same).drop(*names)
    rest = rows.join(F.broadcast(heavy.select(*names)), same, "left_anti").join(other.where(F.col(weight) <= limit), same).drop(*names)
    return hot.unionByName(rest)
