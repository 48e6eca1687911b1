"""Breadth-first crawling, level by level, and reachability over a link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import SITE, Site
from docloom.functions.html import main_text_exact, page_links
from docloom.functions.text import normalize
from docloom.functions.urls import canonical, is_html, is_pdf
from docloom.operators.persist import checkpointed
from docloom.plugins import Fetcher, PageTextExtractor
from docloom.sources.documents import chunk_remote_documents, decoded, fetch, web_rows


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of each node reachable over (src, dst) from the seeds' `node`.  Each level is written once."""
    levels = [checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))]
    while (max_depth is None or len(levels) <= max_depth) and not levels[-1].isEmpty():
        frontier, seen = levels[-1], reduce(DataFrame.union, levels)
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        levels.append(checkpointed(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(len(levels)))))
    return reduce(DataFrame.union, levels)


def _html(fetched: DataFrame, site: Site, *more: str) -> DataFrame:
    """(url, html) of fetched HTML pages (url, content_type, body), and columns `more`."""
    rows = fetched.where(~is_pdf(F.col("url")) & is_html(F.col("content_type"), site))
    return rows.select("url", *more, decoded(F.col("body"), F.col("content_type")).alias("html"))


def crawl(seeds: DataFrame, fetcher: Fetcher | DataFrame, site: Site = SITE, max_pages: int = 1500, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): (url, depth, text) of HTML pages with text, (url, depth) of PDF addresses, to be read by chunk_remote_documents().

    `fetcher` may be a table of fetched pages (see fetch()); `delay` is a pause between a task's fetches in seconds.

    Levels are visited in order, addresses in order inside a level, `max_pages` in all, failures and PDFs included.
    Each level's fetches are checkpointed, so none is repeated.  Links come from the whole page, text from its main part.
    Of a table, pages are read once for their links and once for their text; levels meet addresses only, never bodies.
    """
    spark = seeds.sparkSession
    held = fetcher if isinstance(fetcher, DataFrame) else None
    if held is not None:
        edges = checkpointed(page_links(_html(held, site), site=site).repartition("src"))
    frontier = checkpointed(seeds.select(canonical(F.col("url")).alias("url")).distinct())
    seen = [spark.createDataFrame([], "url string, depth int")]
    pages = spark.createDataFrame([], "url string, depth int, html string")
    depth, left = 0, max_pages
    while left > 0 and (n := frontier.count()):
        now = frontier if n <= left else checkpointed(frontier.orderBy("url").limit(left))  # sorted only where the bound cuts a level
        now = now.withColumn("depth", F.lit(depth))
        left -= min(n, left)
        seen.append(now)
        if held is not None:
            links = edges.join(now.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        else:
            got = _html(fetch(now.where(~is_pdf(F.col("url"))), fetcher, delay=delay).where("error is null"), site)
            got = checkpointed(got.withColumn("depth", F.lit(depth)).select("url", "depth", "html"))
            pages = pages.union(got)
            links = page_links(got, site=site).select(F.col("dst").alias("url")).distinct()
        frontier = checkpointed(links.join(reduce(DataFrame.union, seen).select("url"), "url", "left_anti"))
        depth += 1
    if held is not None:
        pages = _html(held.join(reduce(DataFrame.union, seen), "url"), site, "depth")
    text = normalize(main_text_exact(F.col("html"), site))
    return pages.select("url", "depth", text.alias("text")).where("text <> ''"), reduce(DataFrame.union, seen).where(is_pdf(F.col("url")))


def crawl_documents(seeds: DataFrame, fetcher: Fetcher | DataFrame, extractor: PageTextExtractor, site: Site = SITE, site_name: str = "", max_pages: int = 1500, delay: float = 0.0) -> DataFrame:
    """What a crawl gives a collection: one row for each web page with text, and the chunks of the PDFs that it met."""
    pages, files = crawl(seeds, fetcher, site, max_pages, delay)
    fetcher = fetcher.where(is_pdf(F.col("url"))) if isinstance(fetcher, DataFrame) else fetcher  # no other body is moved
    return web_rows(pages, site_name or site.domain).unionByName(chunk_remote_documents(files.select("url"), fetcher, extractor))
