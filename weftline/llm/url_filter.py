"""URL filters with redirect equivalence: a decision on one address holds for its aliases.

A rule (host, path, verdict) fits its host and all subdomains, where the URL's path starts with the rule's;
the longest rule decides, of equally long ones that with the longer host, then one that allows. A URL that no rule fits takes the method's verdict:
pages name other addresses by a canonical link or a refresh, such edges join addresses to components
(distributed stars over a link table), and a component with a blocked address blocks all its members. An explicit allow
always stands: a URL that a rule allows is allowed in a blocked component too.

An address is host, path and query: the scheme and the fragment name no other resource. Links are taken from the
page's tags outside comments and scripts; a tag ends at its first `>`. Relative links are resolved against the page's own URL.

All work is column expressions, aggregations and joins. Pages are read once for their links and once for the
verdicts; where no page names another, nothing is shuffled. Only addresses of blocked components are
joined with the pages: broadcast if they have been counted and are few, else by a shuffle that splits hot addresses.

Edge cases: a null URL, and one without `://`, has empty host and path, fits no rule and has no alias; a null or empty page
names nothing; pages that repeat a row or a URL each give their row; a null id is kept; links to oneself
say nothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import components

#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?:link|meta)\b[^>]*>"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; all empty if it is null or has no `://`. The query keeps its question mark."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    return tuple(F.coalesce(c, F.lit("")) for c in (host, path, query))


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that decides, as a struct with `rule` and `verdict`; null if none fits. The rules are a literal of the plan."""
    by_host: dict[str, list] = {}
    for name, start, verdict in rules:
        by_host.setdefault(name, []).append((start, verdict, len(name) + len(start), len(name)))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")

    def entry(name, start, verdict, length, host_length):
        return F.struct(
            F.lit(length).alias("length"), F.lit(host_length).alias("host_length"), F.lit(verdict == "allow").alias("allows"),
            F.lit(start).alias("start"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"),
        )

    table = F.create_map(*(x for name, found in by_host.items() for x in (F.lit(name), F.array(*(entry(name, *f) for f in found)))))
    # no suffix of more labels than a rule's host has can match
    tails = [F.substring_index(host, ".", -n) for n in sorted({name.count(".") + 1 for name in by_host})]
    fits = F.flatten(F.filter(F.transform(F.array_distinct(F.array(*tails)), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(fits, lambda x: F.startswith(path, x["start"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def named_links(html: Column) -> Column:
    """The targets, as written, of a page's canonical links and refreshes."""
    tags = F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))

    def target(tag):
        canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(F.btrim(_attribute(tag, "http-equiv"))) == "refresh"
        address = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)""", 1)
        found = F.when(F.lower(F.substring(tag, 1, 5)) == "<link", F.when(canonical, _attribute(tag, "href")))
        found = F.when(F.lower(F.substring(tag, 1, 5)) == "<meta", F.when(refresh, address)).otherwise(found)
        return F.btrim(F.replace(F.replace(found, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")))

    return F.filter(F.transform(tags, target), lambda x: x.isNotNull() & (x != ""))


def _plain_path(path: Column) -> Column:
    """The path without dot segments."""
    step = lambda held, part: (
        F.when(part == ".", held).when(part == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(part)))
    )
    pieces = F.split(path, "/")
    last = F.element_at(pieces, -1).isin(".", "..")
    walked = F.array_join(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")), step), "/")
    return F.when(F.contains(path, F.lit("/.")), F.when(last, F.concat(walked, F.lit("/"))).otherwise(walked)).otherwise(path)


def resolved(link: Column, host: Column, path: Column, query: Column) -> Column:
    """The link as an absolute URL, seen from the page's address. Null if it leads to no host."""
    whole = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    other = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    place, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/"))
    full = F.when(F.startswith(place, F.lit("/")), place).when(place == "", path).otherwise(F.concat(folder, place))
    own = F.when((place == "") & ~F.startswith(tail, F.lit("?")), query).otherwise(F.lit(""))
    near = F.when(host != "", F.concat(F.lit("http://"), host, _plain_path(full), own, tail))
    return F.when(whole, link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).when(~other, near)


def address(host: Column, path: Column, query: Column) -> Column:
    """128 bits that name an address; null without a host. An empty path is the root's."""
    root = F.when(path == "", "/").otherwise(path)
    return F.when(host != "", F.unhex(F.md5(F.concat(host, root, query))))


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source_url, target_url) of every canonical link and refresh of the pages, targets resolved."""
    # Arrays of links are empty for most pages: they are dropped before anything is moved.
    held = pages.select(F.col(url_col).alias("source_url"), F.explode(named_links(F.col(html_col))).alias("link"))
    target = resolved(F.col("link"), *parts(F.col("source_url")))
    return held.select("source_url", target.alias("target_url")).where("target_url IS NOT NULL")


def blocked_aliases(links: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """node: the addresses of every component of the links (source_url, target_url) that holds a blocked address. Stored."""

    def end(name):
        host, path, query = parts(F.col(name))
        return F.struct(address(host, path, query).alias("node"), F.coalesce(decided(host, path, rules)["verdict"] == "block", F.lit(False)).alias("blocked"))

    pairs = common.stored(links.select(end("source_url").alias("x"), end("target_url").alias("y")).where("x.node IS NOT NULL AND y.node IS NOT NULL").distinct(), "url-links")
    nodes = pairs.select("x.*").unionByName(pairs.select("y.*")).groupBy("node").agg(F.max("blocked").alias("blocked"))
    roots = components(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    placed = common.stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "url-nodes")
    bad = common.stored(placed.groupBy("root").agg(F.max("blocked").alias("blocked"), F.count(F.lit(1)).alias("members")).where("blocked").drop("blocked"), "url-roots")
    return common.stored(common.join_split(placed.drop("blocked"), bad, ["root"], "members").select("node"), "url-blocked")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by (rule, alias or default) of every page.

    `redirects` (source_url, target_url): further edges, as a crawler logs them.
    """
    host, path, query = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    rows = rows.withColumn("d", decided(F.col("host"), F.col("path"), rules)).withColumn("node", address(*map(F.col, ("host", "path", "query"))))
    found = edges(pages, url_col, html_col)
    if redirects is not None:
        found = found.unionByName(redirects.select("source_url", "target_url"))
    links = common.stored(found, "url-edges")
    if links.isEmpty():
        marked = rows.withColumn("alias", F.lit(False))
    else:
        bad = blocked_aliases(links, rules).withColumn("alias", F.lit(True))
        if len(bad.take(common.BROADCAST_ROWS + 1)) <= common.BROADCAST_ROWS:
            marked = rows.join(F.broadcast(bad), "node", "left")
        else:
            seen = rows.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("pages"))
            hit = common.stored(bad.join(seen, "node"), "url-hit")
            rest = rows.where("node IS NOT NULL").join(bad, "node", "left_anti").unionByName(rows.where("node IS NULL"))
            marked = common.join_split(rows, hit, ["node"], "pages").drop("pages").unionByName(rest.withColumn("alias", F.lit(False)))
    alias = F.coalesce("alias", F.lit(False))
    return marked.select(
        "page_id", "host", "path", F.col("d.rule").alias("rule"),
        F.coalesce("d.verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("d").isNotNull(), "rule").when(alias, "alias").otherwise("default").alias("decided_by"),
    )
