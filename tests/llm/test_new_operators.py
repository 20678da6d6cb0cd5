"""Turn repair, URL filters and spelling variants against plain restatements."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from weftline.llm import common, queries, spelling, turn_repair, url_filter

SPACES = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Rows after damage by conversation, in order."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        found[conv] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, part in found.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every choice of kept, renamed and deleted rows, and every legal string that holds what stays."""
    best = None
    marks = faults(turns)
    for choice in itertools.product("DKR", repeat=len(turns)):
        if any(c != "D" and m in ("blank", "duplicate") for c, m in zip(choice, marks, strict=True)):
            continue
        base = sum({"D": 2, "K": 0, "R": 1}[c] + (5 if c != "D" and m == "truncated" else 0) for c, m in zip(choice, marks, strict=True))
        stay = [(c, t) for c, t in zip(choice, turns, strict=True) if c != "D"]
        for size in range(len(stay), 2 * len(stay) + 3):
            for lead in ("", "s"):
                rest = size - len(lead)
                if rest < 0 or rest % 2 or (lead and not rest):
                    continue
                goal = lead + "ua" * (rest // 2)
                for taken in itertools.combinations(range(size), len(stay)):
                    at = dict(zip(taken, stay, strict=True))
                    if any(i not in at and x == "s" for i, x in enumerate(goal)):
                        continue
                    if any((c == "K" and t[1][:1] != goal[i]) or (c == "R" and goal[i] == "s") for i, (c, t) in at.items()):
                        continue
                    cost = base + 5 * (size - len(stay))
                    if best is not None and cost > best[0]:
                        continue
                    names = {"s": "system", "u": "user", "a": "assistant"}
                    made = [f"{at[i][1][1] if at[i][0] == 'K' else names[x]}:{at[i][1][2]}" if i in at else names[x] + ":" for i, x in enumerate(goal)]
                    # deletions and insertions between kept rows may come in any order: the least string has D first
                    ops, i = [], 0
                    for c in (*choice, None):
                        if c == "D":
                            ops.append("D")
                            continue
                        while i < size and i not in at:
                            ops.append("I")
                            i += 1
                        if c is not None:
                            ops.append(c)
                            i += 1
                    found = (cost, "".join(ops), made)
                    best = found if best is None else min(best, found, key=lambda b: b[:2])
    return best


def conversations(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "", " \t", "cut off", "Why?", "Yes.", "long " * 50 + "end.", None, "end. \n", "half "]
    roles = ["user", "assistant", "user", "assistant", "system", "Assistant", "", None, "agent", "ugly"]
    rows = []
    for c in [*range(60), None]:
        rows += [(c, t, rng.choice(roles[: rng.choice([2, 4, 5, 10])]), rng.choice(texts)) for t in rng.sample([*range(8), None, 40], rng.randrange(1, 6))]
    rows += rows[5:8] + [(99, None, "user", "Hm."), (100, 2**62, "user", "A."), (100, -(2**62), "assistant", "B."), (101, 3, "user", "x" * 300_000 + ".")]
    return rows


TURNS = "conv_id long, turn long, role string, text string, c string, fault int, at long, kind int, n long"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9, 9, 9) for r in rows], TURNS)


def wanted(rows):
    out = {}
    for conv, turns in damage(rows).items():
        marks, heads = faults(turns), [r[:1] for _, r, _ in turns]
        known = {t for t, *_ in turns if t is not None}
        gaps = min(max(known) - min(known) + 1 - len(known), 2**63 - 1) if known else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(heads, heads[1:], strict=False))
        cost, audit, made = cheapest(turns)
        out[conv] = (gaps, *map(marks.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"large_rows": 1, "large_bytes": 10, "chunk": 2}])
def test_turn_repair(spark, sizes):
    rows = conversations()
    got = turn_repair.repair_report(turn_frame(spark, rows), **sizes).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == wanted(rows) and len(got) == len({r[0] for r in rows})


def test_turn_repair_pieces_and_empty(spark, monkeypatch):
    rows = conversations(4)
    monkeypatch.setattr(turn_repair, "PIECE", 8)
    cut = turn_repair.repair_report(turn_frame(spark, rows), large_rows=2, chunk=3)
    assert {r.conv_id: tuple(r)[1:] for r in cut.collect()} == wanted(rows)
    none = turn_repair.repair_report(turn_frame(spark, []))
    assert none.columns == cut.columns and none.count() == 0


@pytest.mark.parametrize("name", ["op11_turn_repair", "op13_spelling"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    turns = spark.createDataFrame(conversations(6), "conv_id long, turn long, role string, text string")
    words = spark.createDataFrame(spelled(7), "doc_id long, text string")
    for table, frame in (("conversations", turns.where("abs(turn) < 1000 OR turn IS NULL")), ("documents", words)):
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = collections.Counter(tuple(r[c] for c in want.columns) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == collections.Counter(want.fetchall())


def test_turn_repair_audits_are_legal():
    rng = random.Random(8)
    for _ in range(300):
        turns = [(rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b.", "c", ""]), 0) for _ in range(rng.randrange(0, 30))]
        marked = [(r, t, 1 if not t else 3 if t == "c" else 0) for r, t, _ in turns]
        *_, audit, _ = turn_repair.repair(marked)
        assert sum(c != "I" for c in audit) == len(turns)
        initials, state, rows = "", 0, iter(turns)
        for edit in audit:
            role = next(rows)[0] if edit != "I" else None
            if edit != "D":
                initials += role[0] if edit == "K" else turn_repair._ROLE[state][0]
                state = turn_repair._AFTER[initials[-1]][state]
        assert LEGAL.match(initials)


PAGES = [
    (1, "http://A.example.com/en/1#x", "<link rel='canonical' href='/de/9'>"),
    (2, "https://a.example.com/de/9", ""),
    (3, "http://q.org/a?b=1#c", '<meta http-equiv="refresh" content="0; url=http://x.net/es/7">'),
    (4, "http://q.org/a?b=1", None),
    (5, "q.org/a", ""),
    (6, None, None),
    (7, "http://q.org", "<!-- <link rel=canonical href=http://x.net/es/1> --><script>'<link rel=canonical href=http://x.net/es/1>'</script>"),
    (8, "http://q.org/c/d?x&y", ""),
    (9, "http://com/", ""),
    (10, "http://xcom/", ""),
    (11, "http://www.example.com/en/1", "<link rel=canonical href=http://a.net/fr/>"),
    (12, "http://a.com:80/", ""),
    (13, "http://u.org/en", '<link rel="canonical" href="https://q.org/a?b=1">'),
    (14, "x://y://z.net/es/", ""),
    (None, "http://q.org/a?b=1", None),
    (15, "https://v.org/", "<p>" + "x" * 300_000 + '<link rel="alternate canonical" href="//U.org/en#frag">'),
    (4, "http://q.org/a?b=1", None),
    (16, "", ""),
    (17, "http://", "<link rel=canonical href=/a>"),
]
BLOCKED_ALIASES = {3, 4, 13, 15, None}


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", True) for r in rows], "page_id long, url string, html string, host string, node string, alias boolean")


@pytest.mark.parametrize("limit", [50_000, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    got = url_filter.judge(page_frame(spark, PAGES))
    rows = got.collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id for r in rows if r.decided_by == "alias"} == BLOCKED_ALIASES
    assert all(r.verdict == "block" for r in rows if r.decided_by == "alias")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id in (1, 2, 5, 6, 9, 11, 14)} == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("a.example.com", "/de/9", "com/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        9: ("com", "/", "com/", "allow"), 11: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 14: ("y:", "//z.net/es/", None, "allow"),
    }


def test_url_filter_equals_its_sql(spark):
    con = duckdb.connect()
    con.register("pages", page_frame(spark, PAGES).select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"}))
    want = con.sql(queries.ORACLES["op12_url_filter"])
    names = want.columns
    got = collections.Counter(tuple(r[c] for c in names) for r in url_filter.judge(page_frame(spark, PAGES)).collect())
    assert got == collections.Counter(want.fetchall())


def test_url_filter_hub_chain_redirects_and_empty(spark):
    rows = [(i, f"http://h{i}.org/", "") for i in range(1500)]
    links = [(f"http://h{i}.org/", "http://hub.org/") for i in range(1200)] + [(f"http://h{i}.org/", f"http://h{i + 1}.org/") for i in range(1200, 1300)]
    links += [("http://hub.org/", "http://z.net/fr/x"), ("http://www.example.com/en/a", "http://z.net/fr/x")]
    redirects = spark.createDataFrame(links, "source_url string, target_url string")
    got = url_filter.judge(page_frame(spark, rows), redirects=redirects)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(1200))
    assert url_filter.judge(page_frame(spark, [])).count() == 0
    assert {r.verdict for r in url_filter.judge(page_frame(spark, PAGES), rules=()).collect()} == {"allow"}


def test_relative_links_are_resolved(spark):
    cases = [("/x/../y", "/y"), ("b", "/p/b"), ("../b?q#f", "/b?q#f"), ("?z", "/p/q?z"), ("#f", "/p/q?o#f"), ("./", "/p/"), ("..", "/"), ("b/./c", "/p/b/c")]
    frame = spark.createDataFrame([(a,) for a, _ in cases], "link string")
    url = url_filter.F.lit("http://h.org/p/q?o#i")
    got = [r[0] for r in frame.select(url_filter.resolved(url_filter.F.col("link"), *url_filter.parts(url))).collect()]
    assert got == ["http://h.org" + b for _, b in cases]


def plain_variants(rows):
    counts = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    mates = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(m, key=lambda v: (-words[v], v)) for w, m in mates.items() if m}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(mates[w]), words.get(form.get(w))) for w, n in words.items()}


def spelled(seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀÿ×e") for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["prefix" + a + b for a in "abcdé" for b in ("", "x", "yz")]
    found = []
    for s in stems:
        found += [s.upper() if rng.random() < 0.3 else s] * rng.choice([3, 6, 12, 40])
        for _ in range(6):
            i = rng.randrange(len(s))
            found += [rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abé") + s[i:], s[:i] + "c" + s[i + 1 :]])] * rng.choice([1, 3, 5, 9])
    rng.shuffle(found)
    texts = [rng.choice([" ", ", ", "1", "\n"]).join(found[i : i + 40]) for i in range(0, len(found), 40)]
    rows = list(enumerate([*texts, None, "", "x", "a" * 100_000, "Ünïcode 你好 \U0001f600word"]))
    return [*rows, rows[0], (None, texts[1])]


@pytest.mark.parametrize("large", [64, 1])
def test_spelling_variants(spark, large):
    rows = spelled()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n long, form string")
    got = spelling.variants(frame, large=large).collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(w[1] and w[2] != w[1] for w in want)


def test_spelling_of_empty_table(spark):
    none = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
