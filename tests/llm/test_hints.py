"""What a page's elements say about themselves ends with them, and means whole names only."""

import re

import pyarrow.parquet as pq
import pytest

from weftline.llm import html_extract

LEAVES = ("p", "h1", "h2", "h6", "li", "dt", "dd", "td", "th")
WRAP = {"li": "<ul>{}</ul>", "dt": "<dl>{}</dl>", "dd": "<dl>{}</dl>", "td": "<table><tr>{}</tr></table>", "th": "<table><tr>{}</tr></table>"}
SENTENCE = "The old stone bridge over the river was closed to all carts for many years after the flood"


def page(tag, attribute, closed):
    """An article whose third block is a leaf of the kind; the leaf's siblings and what follows are plain."""
    sibling = f"<{tag}>{SENTENCE} first.</{tag}>" if tag in WRAP else ""
    leaf = f"{sibling}<{tag}{attribute}>{SENTENCE} leaf." + (f"</{tag}>" if closed else "")
    after = f"<{tag}>{SENTENCE} second.</{tag}>" if tag in WRAP else ""
    return f"<body><article><h1>Bridge</h1><p>{SENTENCE} one.</p>{WRAP.get(tag, '{}').format(leaf + after)}<p>{SENTENCE} two.</p><p>{SENTENCE} three.</p></article></body>"


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("tag", LEAVES)
def test_every_word_on_every_leaf(tag, closed):
    whole = html_extract.main_text(page(tag, "", closed))
    others = [line for line in whole.split("\n") if not line.endswith("leaf.")]
    assert len(others) == len(whole.split("\n")) - 1
    for word in sorted(html_extract._FURNITURE | html_extract._ARTICLE):
        for name in ("id", "title", "data-x", "alt"):
            assert html_extract.main_text(page(tag, f' {name}="{word}"', closed)) == whole, (word, name)
        got = html_extract.main_text(page(tag, f" class='x {word}'", closed)).split("\n")
        assert [line for line in got if not line.endswith("leaf.")] == others, word
        assert html_extract.main_text(page(tag, f' class="{word}-qu {word}wards un{word}"', closed)) == whole, word


def test_hidden_is_an_attribute_not_a_word():
    plain = page("p", "", True)
    whole = html_extract.main_text(plain)
    for edit in ('title="a hidden story"', "data-hidden", 'class="long-form-article"', 'class="ad-hoc-networks"', 'style="color:red"', 'aria-hidden="false"'):
        assert html_extract.main_text(plain.replace("<article>", f"<article {edit}>")) == whole, edit
        assert html_extract.main_text(plain.replace("<article>", f"<article><div {edit}>").replace("</article>", "</div></article>")) == whole, edit
    leaf = [line for line in whole.split("\n") if line.endswith("leaf.")]
    for edit in (" hidden", ' hidden=""', ' style="display : none"', ' aria-hidden="true"', ' class="cookie-banner"', ' class="postComments"', ' role="alert"'):
        assert html_extract.main_text(page("p", edit, True)).split("\n") == [line for line in whole.split("\n") if line not in leaf], edit


def test_furniture_ends_with_its_element():
    nested = f"<article><h1>Bridge</h1><ul><li class=ad>buy<ul><li>more</ul><li>{SENTENCE} kept.</ul><p>{SENTENCE} one.<div class=comments><p>nice<p>very</div><p>{SENTENCE} two.</article>"
    assert [line[-5:] for line in html_extract.main_text(nested).split("\n")] == ["ridge", "kept.", " one.", " two."]
    formula = f"<article><h1>Bridge</h1><p>{SENTENCE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert html_extract.main_text(formula).endswith("flood x=2 holds.")


def test_depth_costs_no_more_than_length():
    deep = "<div>" * 100_000 + f"<article><h1>Bridge</h1><p>{SENTENCE}.</p></article>" + "</span2>" * 100_000 + "<p>x" * 50_000
    assert SENTENCE in html_extract.main_text(deep)


def test_edits_of_real_pages_change_nothing():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    changed = 0
    for html in rows:
        whole = html_extract.main_text(html)
        changed += html_extract.main_text(re.sub("(<article>.*?<p)>", r'\1 class="share-quote">', html, count=1, flags=re.S)) != whole
        changed += html_extract.main_text(html.replace("<h1>", '<h1 id="search">', 1)) != whole
        changed += html_extract.main_text(html.replace("<h1>", '<h1 id="related-work">', 1)) != whole
        changed += html_extract.main_text(html.replace("<article>", '<article title="a hidden story">', 1)) != whole
    assert changed == 0 and len(rows) == 250
