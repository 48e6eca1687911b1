"""Main text and links of HTML: a pattern path in the JVM, and an exact tree in an Arrow UDF."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import NOISE_ELEMENTS as NOISE
from docloom.config import SITE, Site
from docloom.functions.text import strip
from docloom.functions.urls import canonical, is_internal, resolve

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def decode_entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def visible_text(c: Column) -> Column:
    """Text of well-formed markup: tags to separators, each piece trimmed, joined by single spaces, entities decoded."""
    pieces = F.transform(F.split(c, r"<[^>]*>"), lambda x: strip(decode_entities(x)))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def main_text(page: Column, least: int = 200) -> Column:
    """Pattern path: without noise elements, the article if it has `least` characters, else the body, else all."""
    for tag in NOISE:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    page = F.regexp_replace(page, r"(?s)<!--.*?-->|<![^>]*>", "")
    article = visible_text(F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1))
    body = F.regexp_replace(F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*)", 1), r"(?is)</body\s*>.*$", "")  # which may be left open
    return F.when(F.length(article) >= least, article).when(body != "", visible_text(body)).otherwise(visible_text(page))


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children]; an end tag closes the nearest open node of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _walk(node: list):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if not isinstance(x, str):
            stack += reversed([y for y in x[2] if isinstance(y, str) or y[0] not in NOISE])


def _text(node: list) -> str:
    return " ".join(s for x in _walk(node) if isinstance(x, str) and (s := x.strip()))


_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def _open_as_text(page: str) -> str:
    """`page` with each ampersand that starts no complete reference escaped, so that a parser leaves it as it stands."""
    return _REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else "&amp;" + m[0][1:], page)


def tree_text(page: str, site: Site = SITE, least: int = 200, open_references: bool = True) -> str:
    """Main text by the site's selectors in order, then the body, then everything.

    References that lack their semicolon (`&amp<`) are decoded, as browsers do, unless `open_references` is False.
    """
    tree = _Tree()
    tree.feed(page if open_references else _open_as_text(page))
    tree.close()
    nodes = [x for x in _walk(tree.root) if not isinstance(x, str)]
    for tag, attribute, value in site.selectors:
        hit = next((x for x in nodes if (not tag or x[0] == tag) and (not attribute or value in (x[1].get(attribute) or "").split())), None)
        if hit and len(text := _text(hit)) >= least:
            return text
    return _text(next((x for x in nodes if x[0] == "body"), tree.root))


def main_text_exact(page: Column, site: Site = SITE, least: int = 200, open_references: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else tree_text(p, site, least, open_references))

    return run(page)


def link_candidates(page: Column, site: Site = SITE) -> Column:
    """Raw links of a page: anchors, frames, quoted absolute addresses, script paths, data attributes, redirects."""
    quoted = lambda head: rf"""(?i){head}\s*=\s*["']([^"']+)["']"""
    found = [
        F.regexp_extract_all(page, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), 1),
        F.regexp_extract_all(page, F.lit(r"""(?is)<iframe\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""), 1),
        F.regexp_extract_all(page, F.lit(r"""["'](https?://[^"']+)["']"""), 1),
        F.regexp_extract_all(page, F.lit(quoted("(?:data-href|data-url)")), 1),
        F.regexp_extract_all(page, F.lit(quoted(r"(?:window\.location|location\.href)")), 1),
    ]
    for path in site.script_paths:
        own = F.regexp_extract_all(page, F.lit(rf"""(?i)["']({re.escape(path)}[^"']*\.aspx[^"']*)["']"""), 1)
        found.append(F.transform(own, F.lower))
    return F.array_distinct(F.transform(F.concat(*found), decode_entities))


def page_links(pages, url: str = "url", page: str = "html", site: Site = SITE, internal_only: bool = True):
    """(src, dst): the distinct canonical links of each page, by default those inside the site."""
    rows = pages.select(F.col(url).alias("src"), F.explode(link_candidates(F.col(page), site)).alias("link"))
    rows = rows.select("src", canonical(resolve(F.col("src"), F.col("link"))).alias("dst")).where("dst is not null")
    return (rows.where(is_internal(F.col("dst"), site)) if internal_only else rows).distinct()


