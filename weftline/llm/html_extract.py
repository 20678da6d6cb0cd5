"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link
density, those of the blocks before and after it, whether a heading has come, and what its enclosing
elements say, if they say anything (article or page furniture). A small decision tree, grown on the
labelled table below, keeps or drops each block. The table holds every page twice, as it is and with
nothing said by its elements, so that words, links and neighbours decide wherever a page has no hints.
Pages are independent: the work is one narrow pass without a shuffle.

Edge cases: a null or empty page gives the empty text; unclosed, crossing and truncated tags,
comments and unterminated scripts are read as browsers do; repeated rows each give their row;
an empty table gives an empty result. Columns other than the id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)

#: Elements whose content is never text of the page.
_SKIPPED = frozenset("script style noscript template textarea title iframe svg annotation object select option button canvas audio video head".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr nobr acronym ruby rt rp input math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover "
    "munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose mmultiscripts semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FLOW = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are closed by the next of their kind, and the elements that this does not reach beyond.
_LEAVES = {
    "p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",),
    "thead": ("table",), "tbody": ("table",), "tfoot": ("table",),
}
_KIN = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
_FURNITURE_TAGS = frozenset("nav aside footer form menu dialog fieldset address".split())
_ARTICLE_TAGS = frozenset("article main".split())
_FURNITURE = frozenset(
    "nav navbar navigation menu sidebar aside footer foot masthead banner ad ads advert adverts advertisement sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice alert warning comment comments disqus reply replies respond share sharing social "
    "related recommended breadcrumb breadcrumbs pagination pager login signin signup subscribe newsletter popup modal overlay widget "
    "tags copyright toolbar search form contentinfo complementary".split()
)
_ARTICLE = frozenset("article content post entry story main body text".split())
#: What may stand beside such a word in a name like "main-menu" or "commentList".
_BESIDE = frozenset(
    "site page main top bottom left right box list bar section block wrapper wrap container area inner outer item items slot unit panel post "
    "posts article content primary secondary global group row column col text link links icon button user reader message messages body "
    "entry thread fixed sticky the div gpt google header".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: `says`: 1 inside an article, -1 inside page furniture, 0 where no element says anything.
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "headed", "says", "article_on_page",
)

#: The labelled table: pages as block lists of (enclosing kind, tag, words, linked words, is main text).
#: Kinds: a article, f furniture, n neither, x furniture inside an article.
LABELLED = (
    (("f", "li", 1, 1, 0), ("f", "li", 2, 2, 0), ("f", "div", 9, 0, 0), ("a", "h1", 8, 0, 1), ("a", "p", 60, 0, 1), ("a", "p", 1, 0, 1), ("a", "p", 4, 1, 1), ("x", "p", 30, 2, 0), ("f", "p", 12, 0, 0)),
    (("f", "a", 1, 1, 0), ("a", "h1", 1, 0, 1), ("a", "p", 2, 0, 1), ("a", "p", 120, 6, 1), ("a", "h2", 5, 0, 1), ("a", "li", 7, 0, 1), ("a", "li", 6, 6, 1), ("f", "p", 40, 3, 0), ("f", "p", 70, 0, 0)),
    (("f", "p", 45, 2, 0), ("f", "li", 1, 1, 0), ("n", "p", 11, 9, 0), ("a", "p", 80, 0, 1), ("x", "div", 14, 0, 0), ("a", "p", 33, 2, 1), ("a", "p", 3, 0, 1), ("n", "p", 9, 0, 0), ("f", "div", 25, 1, 0)),
    (("n", "li", 2, 2, 0), ("n", "li", 1, 1, 0), ("n", "h1", 7, 0, 1), ("n", "p", 52, 1, 1), ("n", "p", 48, 0, 1), ("n", "p", 12, 0, 1), ("n", "p", 39, 0, 1), ("n", "li", 4, 4, 0), ("n", "p", 6, 2, 0)),
    (("n", "div", 3, 3, 0), ("n", "div", 2, 0, 0), ("n", "h2", 6, 0, 1), ("n", "p", 90, 4, 1), ("n", "p", 25, 0, 1), ("n", "p", 31, 1, 1), ("n", "div", 5, 5, 0), ("n", "div", 8, 7, 0), ("n", "div", 4, 0, 0)),
    (("f", "p", 20, 0, 0), ("n", "p", 15, 12, 0), ("f", "h3", 2, 0, 0), ("f", "p", 65, 0, 0), ("a", "h1", 5, 0, 1), ("a", "p", 5, 0, 1), ("x", "p", 55, 0, 0), ("x", "h3", 1, 0, 0), ("n", "p", 30, 0, 0)),
    (("n", "p", 1, 0, 0), ("n", "li", 3, 3, 0), ("n", "li", 2, 2, 0), ("n", "p", 2, 1, 0), ("n", "p", 70, 0, 1), ("n", "p", 66, 3, 1), ("n", "div", 3, 0, 0), ("n", "div", 6, 6, 0), ("n", "div", 2, 2, 0)),
    (("f", "li", 1, 1, 0), ("f", "li", 1, 1, 0), ("f", "li", 3, 3, 0), ("f", "div", 8, 0, 0), ("a", "h1", 11, 0, 1), ("a", "p", 34, 0, 1), ("a", "p", 17, 0, 1), ("a", "p", 9, 0, 1), ("a", "p", 130, 2, 1), ("f", "p", 13, 0, 0)),
    (("f", "li", 2, 2, 0), ("f", "div", 14, 0, 0), ("a", "h1", 6, 0, 1), ("a", "p", 7, 0, 1), ("a", "p", 22, 0, 1), ("a", "h2", 3, 0, 1), ("a", "p", 5, 0, 1), ("a", "p", 41, 0, 1), ("f", "div", 10, 1, 0)),
    (("n", "div", 6, 0, 0), ("n", "li", 1, 1, 0), ("n", "li", 1, 1, 0), ("n", "h1", 9, 0, 1), ("n", "p", 3, 0, 1), ("n", "p", 15, 0, 1), ("n", "li", 5, 0, 1), ("n", "li", 8, 1, 1), ("n", "p", 77, 0, 1), ("n", "p", 19, 0, 1), ("n", "div", 11, 0, 0)),
    (("n", "li", 1, 1, 0), ("n", "li", 4, 4, 0), ("n", "div", 12, 0, 0), ("n", "h1", 4, 0, 1), ("n", "p", 28, 0, 1), ("n", "p", 6, 0, 1), ("n", "p", 10, 0, 1), ("n", "p", 210, 9, 1), ("n", "p", 2, 0, 1), ("n", "p", 58, 0, 1), ("n", "div", 15, 2, 0), ("n", "div", 7, 0, 0)),
    (("f", "p", 18, 1, 0), ("f", "li", 2, 2, 0), ("n", "h2", 5, 0, 1), ("n", "p", 44, 0, 1), ("n", "p", 13, 0, 1), ("n", "p", 61, 1, 1), ("n", "h3", 2, 0, 1), ("n", "p", 8, 0, 1), ("n", "p", 37, 0, 1), ("f", "li", 3, 3, 0), ("f", "li", 4, 4, 0), ("f", "p", 9, 0, 0)),
    (("f", "div", 22, 0, 0), ("n", "li", 1, 1, 0), ("a", "h1", 3, 0, 1), ("a", "p", 12, 0, 1), ("x", "p", 40, 0, 0), ("a", "p", 26, 0, 1), ("f", "h3", 1, 0, 0), ("f", "p", 24, 0, 0), ("f", "p", 16, 0, 0), ("f", "p", 8, 0, 0)),
    (("f", "li", 1, 1, 0), ("a", "h1", 4, 0, 1), ("a", "p", 5, 2, 1), ("a", "li", 3, 3, 1), ("a", "li", 4, 4, 1), ("a", "li", 2, 2, 1), ("a", "p", 9, 4, 1), ("a", "p", 30, 8, 1), ("a", "p", 6, 1, 1), ("a", "p", 12, 12, 1), ("f", "div", 9, 0, 0)),
    (("f", "li", 2, 2, 0), ("f", "li", 1, 1, 0), ("a", "h1", 2, 0, 1), ("a", "p", 1, 1, 1), ("a", "p", 7, 0, 1), ("a", "p", 3, 0, 1), ("a", "li", 8, 8, 1), ("a", "li", 1, 0, 1), ("a", "p", 2, 0, 1), ("a", "h2", 2, 2, 1), ("a", "p", 4, 2, 1), ("f", "li", 5, 5, 0), ("f", "p", 70, 0, 0)),
)


@lru_cache(maxsize=4096)
def _says(name: str) -> tuple[bool, bool]:
    """(article, furniture) of one class, id or role: a listed word, or listed words beside neutral ones only."""
    parts = [x.lower() for x in _PARTS.findall(name) if not x.isdigit()]
    furniture = any(x in _FURNITURE for x in parts) and all(x in _FURNITURE or x in _BESIDE for x in parts)
    article = not furniture and any(x in _ARTICLE for x in parts) and all(x in _ARTICLE or x in _BESIDE for x in parts)
    return article, furniture or name == "site-header"


def _hints(name: str, written: str) -> tuple[bool, bool]:
    """(article, furniture) as an element's attributes say. Headings are named after what they announce and say nothing, ids of leaves likewise."""
    article = furniture = False
    for m in _ATTRIBUTE.finditer(written):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _NOT_SHOWN.search(value):
            furniture = True
        elif name not in _FLOW and (key in ("class", "role") or key in ("id", "aria-label") and name not in _LEAVES):
            for word in value.split():
                says = _says(word) if len(word) <= 64 else (False, False)
                article, furniture = article or says[0], furniture or says[1]
    return article, furniture


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    heading: bool


class _Open:
    """The open elements, each with whether it stands in an article and in furniture."""

    def __init__(self):
        self._stack: list[tuple[str, bool, bool]] = []
        self._names: Counter = Counter()

    @property
    def article(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    @property
    def furniture(self) -> bool:
        return bool(self._stack) and self._stack[-1][2]

    def push(self, name: str, article: bool, furniture: bool) -> None:
        self._stack.append((name, self.article or article, self.furniture or furniture))
        self._names[name] += 1

    def pop(self) -> None:
        self._names[self._stack.pop()[0]] -= 1

    def close(self, names: tuple[str, ...], beyond: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of such a name, and all within, unless one of `beyond` stands between."""
        if not any(self._names[n] for n in names):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            name = self._stack[i][0]
            if name in names:
                while len(self._stack) > i:
                    self.pop()
                return
            if name in beyond:
                return

    def close_text(self) -> None:
        """No block stands in a paragraph or a heading: the next one ends it."""
        while self._stack and (self._stack[-1][0] == "p" or self._stack[-1][0] in _FLOW):
            self.pop()


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; blocks without words are left out."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack = _Open()
    heading = in_link = False
    at = 0

    def flush() -> None:
        nonlocal in_link
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                links = len(_html.unescape(" ".join(linked)).split())
                found.append(Block(text, words, min(words, links), stack.article, stack.furniture, heading))
            parts.clear()
        linked.clear()
        in_link = False

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            if in_link:
                linked.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m[1])
        if name in _SKIPPED:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            if name in ("button", "select"):
                parts.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            if in_link:
                linked.append(" ")
            continue
        flush()
        heading = name in _FLOW and not closing
        if closing:
            stack.close((name,), _LEAVES.get(name, ()))
            continue
        stack.close_text()
        if name in _VOID:
            continue
        if name in _LEAVES:
            stack.close(_KIN.get(name, (name,)), _LEAVES[name])
        article, furniture = _hints(name, m[3]) if m[3] else (False, False)
        if name in ("body", "html"):
            furniture = False
        furniture = furniture or name in _FURNITURE_TAGS or (name == "header" and not stack.article)
        plain = name in _LEAVES or name in _FLOW or name in ("body", "html")
        stack.push(name, name in _ARTICLE_TAGS or (article and not furniture and not plain), furniture)
    flush()
    return found


def _vectors(kinds: list[tuple[int, int, bool, bool, bool]]) -> list[tuple]:
    """The features of a page's blocks, given as (words, linked words, article, furniture, heading)."""
    on_page = float(any(k[2] and not k[3] for k in kinds))
    edge = (0.0, 0.0)
    pairs = [edge, *((float(w), n / w if w else 0.0) for w, n, *_ in kinds), edge]
    found, headed = [], 0.0
    for i, (_, _, article, furniture, heading) in enumerate(kinds):
        headed = max(headed, float(heading and not furniture))
        found.append((*pairs[i + 1], *pairs[i], *pairs[i + 2], float(heading), headed, -1.0 if furniture else float(article), on_page))
    return found


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 4):
    """A decision tree: (feature, limit, below, above) inside, a class at the leaves of `least` rows or more. Splits by Gini impurity."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            below = x[:, f] <= limit
            if min(below.sum(), (~below).sum()) < least:
                continue
            cost = sum(part.size * p * (1 - p) for part in (y[below], y[~below]) for p in (part.mean(),))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(limit), below)
    if best is None:
        return bool(share >= 0.5)
    _, f, limit, below = best
    return (f, limit, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least))


def decide(tree, features: tuple) -> bool:
    while not isinstance(tree, bool):
        f, limit, below, above = tree
        tree = below if features[f] <= limit else above
    return tree


def labelled_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table: each page as it is, and without what its elements say."""
    x, y = [], []
    for page in LABELLED:
        for hints in (True, False):
            kinds = [(w, n, hints and k in "ax", hints and k in "fx", tag in _FLOW) for k, tag, w, n, _ in page]
            x += _vectors(kinds)
            y += [bool(main) for *_, main in page]
    return np.array(x), np.array(y, float)


@lru_cache(maxsize=1)
def trained(depth: int = 7):
    """The tree. Its first question is whether the page marks its article, since such marks settle most of what
    words and links leave open; each answer's part is grown on the rows of that kind."""
    x, y = labelled_vectors()
    marked = x[:, FEATURES.index("article_on_page")] > 0.5
    return (FEATURES.index("article_on_page"), 0.5, grow(x[~marked], y[~marked], depth), grow(x[marked], y[marked], depth))


def main_text(page: str | None, tree=None) -> str:
    """The page's main text, one line per block."""
    if not page:
        return ""
    tree = trained() if tree is None else tree
    cut = blocks(page)
    vectors = _vectors([(b.words, b.linked, b.article, b.furniture, b.heading) for b in cut])
    return "\n".join(b.text for b, v in zip(cut, vectors, strict=True) if decide(tree, v))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(narrow.dtypes)["page_id"]
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
