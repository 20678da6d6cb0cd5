"""Greedy deduplication reads texts once, and in each round only what is not decided yet."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup
from weftline.plans import curation
from weftline.sources.shared import durable


def test_rounds_read_open_links_only(spark):
    rng = random.Random(5)
    chain = [(1 << i) - 1 for i in range(8)]
    hashes = [*chain, *{rng.getrandbits(40) << 23 for _ in range(100)}]
    rows = spark.createDataFrame([("p", i, h, f"f{i}") for i, h in enumerate(hashes)], "profile string, ord long, simhash long, fingerprint string")
    sizes = []

    def store(df):
        sizes.append(durable(df))
        return sizes[-1]

    got = {r.ord: r.status for r in dedup.greedy(rows, store, 1).collect()}
    assert {i: got[i] for i in range(8)} == {i: "near_duplicate" if i % 2 else "kept" for i in range(8)}
    assert set(got.values()) == {"kept", "near_duplicate"} and sum(s == "kept" for s in got.values()) == len(hashes) - 4
    # nodes, what needs no round, all states; rounds add the chain's links as they become fewer
    assert sum(df.count() for df in sizes) < 3 * len(hashes) + 8 * 8


def test_texts_are_sanitised_once(spark, tmp_path):
    spark.createDataFrame([(1, "A, b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = curation._simhashes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1


def test_sanitised_code_points(spark):
    """One expression does what two did: other characters become spaces, then runs of white space become one."""
    two = F.regexp_replace(F.lower("t"), r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]", " ")
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["ab".join(points[i : i + 500]) for i in range(0, len(points), 500)] + [" , ", "", "a,\x1c ;b_-9"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(T.sanitise(F.col("t")).alias("one"), T.normalise_space(two).alias("two"))
    assert frame.where("one <> two OR one IS NULL").count() == 0


@pytest.mark.parametrize("n", [1, 254, 255, 256, 510, 511, 70_000])
def test_bits_of_many_words(n):
    """A text's bits are counted 255 words at a time."""
    words = [["left", "right", "right"][i % 3] for i in range(n)]
    want = T._hashed(pa.array([["right" if n > 1 else "left"]]), 3)[0]
    assert T._hashed(pa.array([[], ["a"], words, None, words]), 3).to_pylist() == [0, 0, want.as_py(), 0, want.as_py()]
