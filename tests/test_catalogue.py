"""Every query with SQL of its own gives that SQL's rows."""

import collections
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Orders of magnitude slower than the rest; checked at the larger scale by the driver (live ones have tests of their own).
SLOW = {"greedy_dedup", "judged_outcomes", "live_exam_clock", "live_counters", "live_focus"}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_query(spark, sql, name):
    frame = catalogue.QUERIES[name](spark, DIR)
    want = sql.sql(catalogue.ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(frame.columns)
    rows = collections.Counter(tuple(plain(r[c]) for c in order) for r in frame.collect())
    assert rows == collections.Counter(tuple(plain(v) for v in (dict(zip(want.columns, r, strict=True))[c] for c in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
