"""Every operator against a plain restatement of what it promises."""

import collections
import hashlib
import random
import re
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, exact_dedup, fingerprints, mixing, ngram_join, packing, sharding, substring_dedup
from tests.llm.conftest import words
from weftline.llm.tokens import ByteBpe, default_path

SPACE = re.compile("[\x20\x09-\x0d]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def test_exact_dedup(docs, rows):
    got = exact_dedup.duplicate_report(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = digest[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.group_size, r.keep_id) == (len(ids), least)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == dict.fromkeys(digest, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.deduplicate(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len(digest)


def test_exact_dedup_heavy_and_light_agree(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text")).write.parquet(f"{tmp_path}/d")
    got = exact_dedup.duplicate_report(spark.read.parquet(f"{tmp_path}/d"))
    assert got.where("keep_id = 0").select("group_size").distinct().collect()[0][0] == 1334
    assert got.where("kept").count() == 1 + 600
    assert got.where("kept AND doc_id <> keep_id").count() == 0


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    loads = [sum(r["size"] for r in by[s]) for s in range(4)]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)


def test_slot_map_versions_and_growth(spark, docs):
    assigned = sharding.assign_slots(docs, 64)
    stats = sharding.slot_statistics(sharding.with_fragments(assigned, sharding.large_slots(assigned, 64)))
    versions = sharding.SlotMap(spark)
    versions.save(sharding.initial_map(stats, 3))
    versions.save(sharding.rebalanced(versions.load(0), 3))
    versions.save(sharding.rebalanced(versions.load(1), 4))
    one, two = ({(r.slot, r.fragment): r.shard for r in versions.load(v).collect()} for v in (1, 2))
    assert one.keys() == two.keys() and 3 in two.values()
    moved = [k for k in one if one[k] != two[k]]
    assert 0 < len(moved) < len(one)


def test_hot_slot_is_cut(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.shard_documents(docs, 5).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in got]
    assert len(sizes) == 5 and max(sizes) < 1.2 * min(sizes)


@pytest.mark.parametrize("shards", [3, 40, 500])
def test_one_repeated_row_fills_all_shards(spark, shards):
    docs = spark.range(0, 4000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = [r["n"] for r in sharding.shard_documents(docs, shards).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(got) == shards and sum(got) == 4000 and max(got) - min(got) <= 2
    slots = sharding.shard_documents(docs, shards).groupBy("shard").agg((F.max("slot") + 1 == F.count_distinct("slot")).alias("gapless"))
    assert slots.where("NOT gapless").count() == 0


def test_packing(docs, rows):
    got = packing.pack(docs).collect()
    encoder = ByteBpe(default_path())  # the plain library
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.append(encoder.ids(t or ""), np.uint32(0)).astype("<u4")
        at = 0
        for length in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 & (1 << b)]:
            want[i, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)] += 1
            at += length
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and len(r.ids) == r.length for r in got)
    in_order = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order)


def test_ids_of_any_type(spark, tmp_path):
    spark.createDataFrame([("x", "one two three four five"), (None, "one two three four five"), ("b", "one two three four six"), ("c", None)], "doc_id string, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert {(r.doc_id, r.length) for r in packing.pieces(docs).collect()} >= {("c", 1), (None, 4)}
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(docs, 30).collect()}
    assert got == {("x", "b"), (None, "b"), ("b", "b"), ("c", "c")}


def test_fast_ids_are_the_library_s():
    fast, plain = ByteBpe(), ByteBpe(default_path())
    for text in ("it's  12 a\n\nb", "Ünïcode ß Ω", "tab\tx  ", "日本 <|endoftext|> x", "a\x0bb c", "İ ΑΣ", "don't!!  \n \n x", "ж" * 50):
        assert fast.ids(text).tolist() == plain.ids(text).tolist()


def _similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _sketch(fingerprint):
    """(end of the range, hashes) of a fingerprint string."""
    upto, *hashes = (int.from_bytes(bytes.fromhex(x), "big", signed=True) for x in fingerprint.split(" "))
    assert hashes == sorted(set(hashes)) and all(h <= upto for h in hashes)
    return upto, hashes


def _likeness(p, q):
    upto = min(p[0], q[0])
    return _similar(*({h for h in x[1] if h <= upto} for x in (p, q)))


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_report(docs).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    unique = [i for i in texts if i is not None and len(texts[i]) == 1]
    order = sorted((i for i, *_ in rows if i is not None), reverse=True)

    def shingles(t):
        w = split(t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    by_text = collections.defaultdict(set)
    prints = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        if r.doc_id in unique:
            text = texts[r.doc_id][0]
            by_text[text].add(r.fingerprint)
            following = texts[r.next_id][0] if r.next_id in unique else None
            if following is not None and r.doc_id > 0:
                assert r.next_id == max(i for i in order if i < r.doc_id)
                cut = len(text) // 3
                edited = text[: len(text) - cut] + following[:cut]
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                few = [len(shingles(t)) < fingerprints.LEAST for t in (text, edited, following)]
                if few[0] and few[1]:
                    assert r.near_edited == _similar(shingles(text), shingles(edited))
                if few[0] and few[2]:
                    assert r.near_next == _similar(shingles(text), shingles(following))
            assert r.n_chars == len(text)
            size = len(shingles(text))
            upto, hashes = _sketch(r.fingerprint)
            # the narrowest range that leaves enough hashes
            ends = [-(2**63) + 2**64 // d - 1 for d in fingerprints.FRACTIONS]
            inside = [e for e in ends[:-1] if sum(h <= e for h in hashes) >= fingerprints.LEAST and e <= upto]
            assert upto == min(inside, default=ends[-1])
            assert abs(len(hashes) - size * (upto + 2**63) / 2**64) <= 5 * size**0.5
        # both estimates follow from the strings alone
        assert r.near_edited == _likeness(_sketch(r.fingerprint), _sketch(r.edited_fingerprint))
        if r.next_id in unique and r.next_id in prints:
            assert r.near_next == _likeness(_sketch(r.fingerprint), _sketch(prints[r.next_id]))
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_merge_and_contain(spark):
    short, long = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(6000))
    one = fingerprints.with_sketch(fingerprints.with_sketch(spark.createDataFrame([(short, long)], "s string, l string"), "s", "x"), "l", "y")
    x, y = F.col("x"), F.col("y")
    r = one.select(fingerprints.containment(x, y).alias("c"), fingerprints.likeness(x, y).alias("j"), (fingerprints.merged(x, y) == y).alias("m")).first()
    assert r.c == 1.0 and abs(r.j - 396 / 5996) < 0.03 and r.m


def test_fingerprints_merge_into_the_sketch_of_the_union(spark):
    rng = random.Random(4)
    sizes = [0, 1, 5, 15, 16, 17, 30, 60, 70, 127, 128, 129, 300, 1000]

    def hashes(n):
        return sorted({rng.getrandbits(64) - 2**63 for _ in range(n)})

    rows = [(hashes(a), hashes(b)) for a in sizes for b in sizes]
    rows += [(x, sorted({*x[: len(x) // 2], *y})) for x, y in rows[::3]]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    a, b = (fingerprints.ranged(F.col(c)) for c in "ab")
    union = fingerprints.ranged(F.sort_array(F.array_union("a", "b")))
    assert frame.where(fingerprints.merged(a, b) == union).count() == len(rows)


def test_one_row_follows_itself(spark):
    r = fingerprints.fingerprint_report(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


@pytest.mark.parametrize("large", [2000, 1])
def test_substring_dedup(docs, rows, large, monkeypatch):
    k, m = 12, 3
    if large == 1:  # every key that repeats is heavy
        monkeypatch.setattr(common, "LEAST_HEAVY", 1)
    got = substring_dedup.repeat_report(docs, k, m, large).collect()
    found = [split(t) for _, t, *_ in rows]
    count = collections.Counter(tuple(w[j : j + k]) for w in found for j in range(len(w) - k + 1))
    want = collections.Counter()
    for (i, *_), w in zip(rows, found, strict=True):
        gone = set()
        for j in range(len(w) - k + 1):
            if count[tuple(w[j : j + k])] > 1:
                gone.update(range(j, j + k))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 0


def _components(rows, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate(lower))
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        ids[find(a)].append(i)
    least = {root: min((i for i in members if i is not None), default=None) for root, members in ids.items()}
    return collections.Counter((i, len(sets[a]), least[find(a)]) for a, (i, *_) in enumerate(rows)), len(ids)


@pytest.mark.parametrize(
    ("percent", "settings"),
    [
        (85, {}),
        (60, {"LARGE": 2, "FREQUENT": 2, "LEAST_HEAVY": 1}),
        (85, {"LARGE": 2, "FREQUENT": 2}),
        (85, {"FREQUENT": 2, "LARGE": 10**9}),
        (60, {"CLASSES": 1, "FREQUENT": 2}),
        (85, {"CLASSES": 1, "CLASS_TOKENS": 4, "FREQUENT": 2}),
        (60, {"CLASSES": 2, "CLASS_TOKENS": 16, "FREQUENT": 2, "LARGE": 2}),
    ],
)
def test_ngram_join(docs, rows, percent, settings, monkeypatch):
    settings = dict(settings)
    monkeypatch.setattr(common, "LEAST_HEAVY", settings.pop("LEAST_HEAVY", common.LEAST_HEAVY))
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    if "FREQUENT" in settings:
        monkeypatch.setattr(ngram_join.frequent_tokens, "__defaults__", (settings["FREQUENT"], ngram_join.MOST_FREQUENT))
    want, n = _components(rows, percent)
    got = ngram_join.similar_components(docs, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def _hashes(text):
    return ngram_join.shingle_sets(pa.array([text]))[0].tolist()


def _thinly_met(percent=85):
    """Two texts that just link, whose shared rare tokens are dealt over large groups and groups of other pivots."""
    rng = random.Random(7)
    while True:
        x = [f"a{rng.randrange(10**6)}" for _ in range(53)]
        y = [*x[:26], "edited", *x[27:]]
        p, q = (_hashes(" ".join(t))[:8] for t in (x, y))
        both = [h for h in p if h in q]
        seen = {h: max(p.index(h), q.index(h)) + 1 for h in both}
        large, small = both[::2], both[1::2]
        if len(both) >= 4 and all(len(part) + 50 - max(seen[h] for h in part) < 46 for part in (large, small)):
            break
    gram = {h: " ".join(x[i : i + 4]) for i in range(50) for h in _hashes(" ".join(x[i : i + 4]))}
    texts = [" ".join(x), " ".join(y)]

    def add(h, more, prefix):
        while True:
            text = " ".join([gram[h], *(f"b{rng.randrange(10**6)}" for _ in range(more))])
            if h in _hashes(text)[:prefix]:
                texts.append(text)
                return

    for h in large:
        for _ in range(20):
            add(h, 13, 3)
    for h in small:
        add(h, 1, 1)
    return [(i, t, None, None) for i, t in enumerate(texts)]


def test_ngram_join_finds_what_single_passes_see_in_part(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.frequent_tokens, "__defaults__", (ngram_join.FREQUENT, 0))
    assert ngram_join.LARGE < 20
    rows = _thinly_met()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs, 85).collect()}
    want, _ = _components(rows, 85)
    assert collections.Counter((i, c) for i, c in got.items()) == collections.Counter((i, c) for i, _, c in want) and got[1] == 0


def test_ngram_signatures_grow_with_a_set_and_meet():
    rng = np.random.default_rng(1)
    sizes = {}
    for n in (50_000, 400_000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sizes[n] = len(ngram_join.signatures(x, np.ones(len(x), bool))[0])
    assert sizes[400_000] < 9 * sizes[50_000] and sizes[400_000] < 4 * 400_000
    # a partner at the limit of likeness, smaller by whole levels of classes too
    for n in (30, 4000, 4096, 4100, 4700, 9000, 70_000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = x[np.sort(rng.permutation(len(x))[ngram_join.allowed_missing(len(x)) :])]
        p, q = (ngram_join.signatures(s, np.ones(len(s), bool))[0] for s in (x, y))
        assert len(np.intersect1d(p, q))


def test_ngram_join_of_a_second_cluster_around_a_pivot(spark, tmp_path):
    """Many texts that share a passage and one edit: near one another, too far from the group's pivot."""
    rng = random.Random(9)
    base = words(rng, 400, 10**6).split(" ")
    other = base[:200] + [f"y{i}" for i in range(60)] + base[260:]
    rows = []
    for i in range(120):
        text = list(base if i % 3 else other)
        for _ in range(3):
            text[rng.randrange(len(text))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want, _ = _components(rows, 85)
    got = ngram_join.similar_components(docs, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_stored_tables_belong_to_their_thread(spark):
    """What one thread clears away is its own, not what another has written meanwhile; the session's setting comes back."""
    inside, written, done = threading.Event(), threading.Event(), {}

    def first():
        with common.cleared(spark):
            done["own"] = common.stored(spark.range(5).toDF("a"), "first")
            inside.set()
            written.wait(60)

    def second():
        inside.wait(60)
        done["kept"] = common.stored(spark.range(7).toDF("a"), "second")
        written.set()

    before = spark.conf.get(common._CLEAN_UP, "false")
    both = [threading.Thread(target=f) for f in (first, second)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert done["kept"].count() == 7 and spark.conf.get(common._CLEAN_UP, "false") == before
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        done["own"].collect()
    assert not common._writers


def test_ngram_representatives(docs, rows):
    _, n = _components(rows, 85)
    stay = ngram_join.representatives(docs)
    assert stay.columns == docs.columns and stay.count() == n


def test_mix(docs, rows):
    got = mixing.mix_report(docs).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(split(t))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(size.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    target = fixed | {s: level * weight[s] for s in free}
    sources = collections.defaultdict(set)
    for i, _, _, s in rows:
        sources[i].add(s)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        if len(sources[r.doc_id]) == 1:
            s = next(iter(sources[r.doc_id]))
            assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert len(set(size.values())) == len(order)
    for s in order:
        largest = max(len(split(t)) for _, t, _, own in rows if own == s)
        assert abs(taken[size[s]] - target[s]) <= largest
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    assert copies.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(taken.values())


def test_mix_takes_repeated_rows_one_by_one(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 7).select(F.lit(None).cast("long").alias("doc_id"), F.lit("five words in each text").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("source"), (F.col("id") % 5).alias("row"), F.lit(0).alias("k"))
    rows.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sorted(round(r.target) for r in got) == [4286, 10714]
    assert all(abs(r.taken - r.target) <= 5 and r.n == 1500 for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken for r in got) // 5
    assert {r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()} == {r.taken // 5 for r in got}


def test_empty_tables(empty):
    for report in (
        exact_dedup.duplicate_report, exact_dedup.deduplicate, fingerprints.fingerprint_report, ngram_join.similar_components,
        mixing.mix_report, mixing.mix, packing.pack, substring_dedup.repeat_report, lambda d: sharding.shard_documents(d, 3),
    ):
        assert report(empty).count() == 0
