"""Link tables (page_url, href, url, ...) and the filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import urls
from boardwalk.functions.fixed import (
    FRAME_EXCLUDED_URLS,
    JOB_URL_PATTERNS,
    MIN_HREF_SLASHES,
    SEARCH_PATTERNS,
)
from boardwalk.functions.nodes import attr
from boardwalk.functions.text import contains_any, hits_any
from boardwalk.operators.substrings import flag_literals


def page_links(shredded: DataFrame, *keys: str) -> DataFrame:
    """E5: every ``a`` with an href, in page order."""
    names = keys or tuple(c for c in shredded.columns if c not in ("texts", "nodes", "base_url"))
    with_href = F.filter(
        "nodes", lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()
    )
    return shredded.select(
        *names, F.col("base_url").alias("page_url"), F.explode(with_href).alias("a")
    ).select(
        *names, "page_url", F.col("a.pre").alias("pre"), attr(F.col("a"), "href").alias("href"),
        F.col("a.in_chrome").alias("in_chrome"),
    )


def scan_hrefs(pages: DataFrame, *keys: str) -> DataFrame:
    """E5 for flat scans: double-quoted hrefs of anchors straight from the text, without a tree
    and without Python. Entities stay as written; use ``page_links`` when they matter."""
    names = keys or ("page_id",)
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s(?:[^>]*\s)?href="([^"]*)"'), F.lit(1))
    return pages.select(*names, F.col("url").alias("page_url"), F.explode(hrefs).alias("href"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Absolute ``url`` from ``href`` and ``page_url``."""
    return links.withColumn("url", urls.resolve(F.col("href"), F.col("page_url")))


def resolve_frame_links(links: DataFrame) -> DataFrame:
    """Absolute ``url`` from ``href`` and ``frame_url``."""
    return links.withColumn("url", urls.resolve_in_frame(F.col("href"), F.col("frame_url")))


def link_hosts(links: DataFrame) -> DataFrame:
    """``host`` and ``origin`` of ``url``."""
    return links.withColumns({"host": urls.host(F.col("url")), "origin": urls.origin(F.col("url"))})


def normalize_links(links: DataFrame) -> DataFrame:
    """U4: ``url_key`` for comparing URLs."""
    return links.withColumn("url_key", urls.normalize(F.col("url")))


def drop_self_links(links: DataFrame) -> DataFrame:
    """Without links back to their own page, whatever the query string."""
    return links.filter(~urls.same_page(F.col("url"), F.col("page_url")))


def http_links(links: DataFrame) -> DataFrame:
    """URLs starting with http."""
    return links.filter(urls.is_http(F.col("url")))


def is_job_link(url: Column, page_url: Column, patterns: list[str] = JOB_URL_PATTERNS) -> Column:
    return urls.is_http(url) & (
        (urls.host(url) != urls.host(page_url)) | contains_any(F.lower(url), patterns)
    )


def job_links(links: DataFrame, patterns: list[str] = JOB_URL_PATTERNS) -> DataFrame:
    """Links to another host, or to a path that looks like a posting."""
    return links.filter(is_job_link(F.col("url"), F.col("page_url"), patterns))


def exclude_links(
    links: DataFrame, patterns: list[str] | str | DataFrame = FRAME_EXCLUDED_URLS, column: str = "url"
) -> DataFrame:
    """U8: without URLs containing a pattern, literally and case-sensitively. ``patterns`` is a
    list, or the name of an array column with the patterns of each row's board, or, for lists of any
    length, a table of them (``pattern``, with ``board_id`` where they hold for one board)."""
    if isinstance(patterns, DataFrame):
        by = ["board_id"] if "board_id" in patterns.columns else []
        flagged = flag_literals(links, F.col(column), patterns, by=by, name="_blocked")
        return flagged.filter(~F.col("_blocked")).drop("_blocked")
    if isinstance(patterns, str):
        blocked = url_blocked(F.col(column), F.col(patterns))
    else:
        blocked = contains_any(F.col(column), patterns)
    return links.filter(~blocked)


def url_blocked(text: Column, patterns: Column) -> Column:
    """A pattern of an array column occurs in the text; an empty pattern hits everything."""
    empty = F.coalesce(F.array_contains(patterns, ""), F.lit(False))
    return empty | hits_any(text, patterns)


def drop_search_links(links: DataFrame) -> DataFrame:
    """Without search and filter pages."""
    return links.filter(~contains_any(F.col("url"), SEARCH_PATTERNS))


def deep_links(links: DataFrame, slashes: int = MIN_HREF_SLASHES) -> DataFrame:
    """Raw hrefs with at least that many slashes."""
    return links.filter(urls.slash_count(F.col("href")) >= slashes)
