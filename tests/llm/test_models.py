"""Trained operators: held-out accuracy, and scores against plain dictionaries."""

import collections
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from weftline.llm import html_extract, language_id, lm_scoring

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["é", "eau", "oi", "ç"]}


def talk(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, talk(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    rows += [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "", None), (903, talk(rng, "cc", 30_000), None), (None, talk(rng, "aa", 40), "aa"), rows[0]]
    path = str(tmp_path_factory.mktemp("spoken") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    return spark.read.parquet(path), rows


def test_language(spoken, monkeypatch):
    docs, rows = spoken
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, _, x in rows if i not in (900, 901, 902)}
    known = [r for r in got if lang.get(r.doc_id)]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) > 0.97 * len(known)
    assert [r.lang_pred for r in got if r.doc_id in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 903).lang_pred == "cc"


def test_language_gradients():
    rng = np.random.default_rng(0)
    x, grads = rng.integers(1, 256, (5, 3)), rng.normal(size=(5, 4, 3))
    inputs, recur = rng.normal(0, 0.2, (12, 256)), rng.normal(0, 0.2, (12, 4))
    inputs[:8] += 0.5
    for d in (0, 1):
        _, kept = language_id._run(inputs, recur, x, d, keep=True)
        g_in, g_rec = language_id._backward(inputs, recur, x, d, kept, grads)
        for params, g, at in ((recur, g_rec, (2, 1)), (recur, g_rec, (9, 3)), (inputs, g_in, (1, x[2, 0])), (inputs, g_in, (10, x[3, 1]))):
            old, value = params[at], []
            for step in (1e-3, -1e-3):
                params[at] = old + step
                value.append((language_id._run(inputs, recur, x, d)[0] * grads).sum())
            params[at] = old
            assert g[at] == pytest.approx((value[0] - value[1]) / 2e-3, rel=0.05, abs=2e-3)


def test_language_labels_positions(spoken):
    model = language_id.fit(spoken[0])
    rng = random.Random(8)
    a, b = talk(rng, "aa", 60), talk(rng, "bb", 60)
    labels = model.label(a + " " + b)
    assert len(labels) == len((a + " " + b).encode())
    assert collections.Counter(labels[: len(a) - 40])["aa"] > 0.8 * (len(a) - 40)
    assert collections.Counter(labels[len(a) + 40 :])["bb"] > 0.8 * (len(b) - 40)


def plain_scores(model, text):
    """Mean probabilities over a text's bytes, gate by gate and byte by byte; reading starts anew in each window."""
    data, total = text.encode(), np.zeros(len(model.languages))
    for start in range(0, len(data), language_id.WINDOW):
        window = data[start : start + language_id.WINDOW] + bytes(max(0, start + language_id.WINDOW - len(data)))
        states = []
        for d in (0, 1):
            k = model.recur[d].shape[1]
            h, found = np.zeros(k), {}
            for t in range(len(window)) if d == 0 else reversed(range(len(window))):
                a, u = model.inputs[d][:, window[t]].astype(float), model.recur[d].astype(float) @ h
                z, r = np.clip(a[:k] + u[:k], 0, 1), np.clip(a[k : 2 * k] + u[k : 2 * k], 0, 1)
                new = np.clip(a[2 * k :] + r * u[2 * k :], -1, 1)
                h = found[t] = (1 - z) * new + z * h
            states.append(found)
        for t in range(min(len(window), len(data) - start)):
            logits = model.bias + sum(model.out[d].astype(float) @ states[d][t] for d in (0, 1))
            total += np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    return total / max(1, len(data))


def test_language_scores_equal_a_plain_reading(spoken):
    docs, rows = spoken
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    rng = random.Random(5)
    for i, text, _ in rng.sample(rows[:240], 40) + [r for r in rows if r[0] == 903]:
        want = plain_scores(model, text)
        assert got[i].score == pytest.approx(want.max(), abs=1e-4)
        assert got[i].lang_pred == model.languages[want.argmax()]


def test_language_with_clashing_names_and_many_labels(spoken, spark, monkeypatch):
    docs, rows = spoken
    wide = docs.selectExpr("*", "'x' AS lang_pred", "2.0D AS score", "7 AS held_out", "1 AS n", "2 AS o", "'y' AS _known", "3 AS passage")
    plain = collections.Counter(map(tuple, language_id.identify(docs).collect()))
    assert collections.Counter(map(tuple, language_id.identify(wide).collect())) == plain
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    most = [lang for lang, _ in sorted(collections.Counter(x for i, t, x in rows if x and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2).items(), key=lambda p: (-p[1], p[0]))][:2]
    assert language_id.fit(docs).languages == sorted(most)


def test_language_learns_what_few_documents_have(spark):
    rng = random.Random(2)
    rows = [(i, talk(rng, "aa" if i % 40 else "bb", 60), "aa" if i % 40 else "bb") for i in range(400)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    few = [talk(rng, "bb", 40) for _ in range(30)]
    assert sum(collections.Counter(model.label(t)).most_common(1)[0][0] == "bb" for t in few) >= 27


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first().lang_pred == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("head", "broadcast"), [(lm_scoring.HEAD_WORDS, lm_scoring.MAX_PAIRS), (40, 5), (0, 0)])
def test_lm_scores(docs, rows, head, broadcast, monkeypatch):
    """Whatever is broadcast, scores are those of plain dictionaries over all words and pairs."""
    monkeypatch.setattr(lm_scoring, "_GATHER", 50 if broadcast == 5 else lm_scoring._GATHER)
    targets = {i for i, *_ in rows if i is not None and i % 3 == 0}
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    got = lm_scoring.cross_entropy_difference(docs, ids, head, broadcast).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [(i, [w.decode().translate(lower) for w in (t or "").encode().split()]) for i, t, *_ in rows]
    pairs = [collections.Counter(), collections.Counter()]
    for i, ws in texts:
        for k in (0, 1) if i in targets else (1,):
            pairs[k].update(zip([None, *ws], ws, strict=False))
    kept = {p for p, n in pairs[1].items() if n >= lm_scoring.MIN_PAIR_COUNT}
    single, context = ([collections.Counter(), collections.Counter()] for _ in (0, 1))
    for k in (0, 1):
        for (a, b), n in pairs[k].items():
            single[k][b] += n
            context[k][a] += n
    size = len(single[1])

    def loss(k, a, b):
        both = pairs[k][a, b] / max(context[k][a], 1) if (a, b) in kept else 0
        return -math.log(0.6 * both + 0.3 * single[k][b] / sum(single[k].values()) + 0.1 / size)

    want = collections.defaultdict(list)
    for i, ws in texts:
        losses = [sum(loss(k, a, b) for a, b in zip([None, *ws], ws, strict=False)) / max(len(ws), 1) for k in (0, 1)]
        want[i].append((len(ws), losses[0], losses[1]))
    assert len(got) == len(rows)
    for r in got:
        near = [w for w in want[r.doc_id] if w[0] == r.n_tokens and r.target_loss == pytest.approx(w[1]) and r.background_loss == pytest.approx(w[2])]
        assert near and r.score == pytest.approx(r.background_loss - r.target_loss)


def test_lm_counts_are_exact_whatever_their_size(spark):
    n = 2**24 + 1
    words = [(1, n, 5, 2, 1), (2, n + 2, n, 0, 0), (-5, 3, 0, 1, 0)]
    pairs = [(0, 1, n - 1, 1), (1, 2, n - 7, 4), (1, -5, 3, 0), (-5, 1, 2, 1)]
    gains = lm_scoring.gains_of(
        spark.createDataFrame(words, "word long, n long, t long, last_n long, last_t long"), spark.createDataFrame(pairs, "before long, word long, n long, t long")
    )
    total = [sum(r[k] for r in words) for k in (2, 1)]
    assert gains[2] == pytest.approx(-math.log(0.1 / 3), rel=1e-15)
    base = {(k, r[0]): 0.3 * r[2 - k] / total[k] + 0.1 / 3 for r in words for k in (0, 1)}
    for r in gains[0].collect():
        assert [r.target, r.background] == pytest.approx([math.log(base[k, r.word] / (0.1 / 3)) for k in (0, 1)], rel=1e-7)
    context = {(k, r[0]): r[2 - k] - r[4 - k] for r in words for k in (0, 1)} | {(0, 0): 1, (1, 0): 3}
    got = {(r.before, r.word): (r.target, r.background) for r in gains[1].collect()}
    assert got.keys() == {r[:2] for r in pairs}
    for r in pairs:
        assert got[r[:2]] == pytest.approx([math.log1p(0.6 * r[3 - k] / max(1, context[k, r[0]]) / base[k, r[1]]) for k in (0, 1)], rel=1e-7)


@pytest.mark.parametrize("broadcast", [100, 0])
def test_lm_targets_by_broadcast_and_by_shuffle(docs, rows, broadcast):
    flagged = lm_scoring.with_target(docs, docs.where("doc_id < 4").select("doc_id"), broadcast).collect()
    want = collections.Counter((t, i is not None and i < 4) for i, t, *_ in rows)
    assert collections.Counter((r.text, r.target) for r in flagged) == want


def test_lm_without_targets(docs, empty):
    for head, broadcast in ((lm_scoring.HEAD_WORDS, lm_scoring.MAX_PAIRS), (3, 5)):
        assert {r.score for r in lm_scoring.cross_entropy_difference(docs, docs.select("doc_id").limit(0), head, broadcast).collect()} == {0.0}
    assert lm_scoring.cross_entropy_difference(empty, empty.select("doc_id")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"<p>"}</style></head><body class="article-page">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies on this site, please accept all of them now.</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First   para<b>graph</b> with
 <a href="x>y">a link</a>.<p>Second<br>part &lt;b&gt; &eacute;<!-- no --><script>var a="</p>";</script><ul><li>One point</li></ul>
<div class="ad">Buy this fine product at a very good price</div><p>Yes.</p><section class="comments"><p>I liked this article very much, thank you.</p></section></article>
<aside><p>Related stories that you may find interesting today</p></aside><form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; 2024 Somebody"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>a < b"), (5, "u", "<div><p>" + "word " * 60 + "</p></div><div><a href=#>more</a></div>"), (1, "u", PAGE), (6, "u", "<script>never ends")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(frame).collect()}
    assert got[1].text.split("\n") == ["Head & line", "First paragraph with a link.", "Second part <b> é", "One point", "Yes."]
    assert [got[k].text for k in (2, 3, 6)] == ["", "", ""]
    assert got[5].text == ("word " * 60).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(frame).count() == len(rows) and html_extract.extract(frame.limit(0)).count() == 0


def test_tree_fits_its_table():
    x, y = html_extract.labelled_vectors()
    hits = [html_extract.decide(html_extract.trained(), tuple(v)) == bool(main) for v, main in zip(x, y, strict=True)]
    assert sum(hits) >= 0.95 * len(hits)


class Article(HTMLParser):
    """What stands inside <article>, one line for each block: the standard library's reading of a page."""

    BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 article section header footer nav aside form table tr td th".split())

    def __init__(self, page):
        super().__init__()
        self.inside = self.skipped = 0
        self.lines, self.now = [], []
        self.feed(page)
        self.close()
        self.end_block()

    def end_block(self):
        if text := " ".join("".join(self.now).split()):
            self.lines.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.end_block()
        if tag == "br":
            self.now.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.end_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.now.append(data)


def without_hints(page):
    """The page with nothing but plain elements around its blocks."""
    page = re.sub(r"<(/?)(?:article|nav|aside|header|footer|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|[^\s>]+)""", "", page)


def test_extraction_of_whole_pages_with_and_without_hints(spark):
    """Against the standard library's parser; without hints, words, links and neighbours find the same article."""
    rng = random.Random(11)

    def say(n):
        return " ".join(rng.choice(["stone", "river", "&eacute;t&eacute;", "a", "walks", "under", "old", "light"]) for _ in range(n))

    pages = []
    for i in range(60):
        links = "".join(f'<li><a href="/{k}">{say(rng.randrange(1, 4))}</a></li>' for k in range(rng.randrange(2, 7)))
        body = "".join(f"<p>{say(rng.choice([2, 6, 14, 40, 90]))}<br>{say(5)}</p>" for _ in range(rng.randrange(1, 6)))
        pages.append(
            f"<html><head><title>{say(4)}</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div class=\"ad\">{say(rng.randrange(4, 12))}</div>"
            f"<article><h1>{say(rng.randrange(1, 12))}</h1>{body}<p>{say(80)}</p></article><footer>&copy; {say(rng.randrange(2, 12))}</footer></body></html>"
        )
    rows = [(i, "u", p, 1, "x") for i, p in enumerate(pages)] + [(100 + i, "u", without_hints(p), 1, "x") for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(frame).collect()}
    assert all(got[i] == Article(p).lines for i, p in enumerate(pages))
    assert sum(got[100 + i] == Article(p).lines for i, p in enumerate(pages)) >= 0.9 * len(pages)
