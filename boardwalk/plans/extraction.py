"""From shredded pages to postings (page_id, board_id, seq, url, title, description).

Each flow is one expression per page row followed by ``inline``: no shuffle, no explode of the
page. ``seq`` is the order of a posting within its page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import nodes as N
from boardwalk.functions.binding import built_once, let
from boardwalk.functions import urls
from boardwalk.functions.fixed import (
    DEFAULT_EXCLUDED_TITLES,
    FRAME_CONTAINER_RULES,
    FRAME_EXCLUDED_TITLES,
    FRAME_EXCLUDED_URLS,
    MIN_HREF_SLASHES,
    MIN_TITLE_WORDS,
    SEARCH_PATTERNS,
)
from boardwalk.functions.text import contains_any, strip, word_count
from boardwalk.operators import containers as C
from boardwalk.operators import titles as T
from boardwalk.operators.links import is_job_link, url_blocked
from boardwalk.operators.skew import BROADCAST_ROWS, lookup_join
from boardwalk.schemas import POSTINGS
from boardwalk.session import stored_with

POSTING_COLUMNS = [f.name for f in POSTINGS.fields]


def _seq(rank: Column, pre: Column) -> Column:
    return F.shiftleft(rank.cast("long"), 32) + pre


def _first_per(postings: Column, *key: str) -> Column:
    """First posting per key within the page. Sorting puts equal keys next to each other, so one
    comparison with the predecessor is enough. The key fields lead the struct, ``seq`` follows."""

    def changed(s: Column, x: Column, i: Column) -> Column:
        differs = F.lit(False)
        for k in key:
            differs = differs | (F.get(s, i - 1)[k] != x[k])
        return (i == 0) | differs

    return let(
        F.array_sort(postings), lambda s: F.filter(s, lambda x, i: changed(s, x, i))
    )


def _rows(shredded: DataFrame, found: Column) -> DataFrame:
    board = F.col("board_id") if "board_id" in shredded.columns else F.lit(None).cast("long")
    return shredded.select("page_id", board.alias("board_id"), F.inline(found)).select(
        *POSTING_COLUMNS
    )


def titled_candidates(page: C.PageView) -> Column:
    """Default candidates with an acceptable link: spans with ``url`` and ``title``."""

    def acceptable(x: Column) -> Column:
        url = x["url"]
        return (
            urls.is_http(url)
            & ~urls.same_page(url, page.base_url)
            & (
                C.is_direct(x["c"])
                | (~contains_any(url, SEARCH_PATTERNS) & is_job_link(url, page.base_url))
            )
        )

    def title(x: Column, named: Column) -> Column:
        c = x["c"]
        return (
            F.when(C.is_direct(c), page.text(c))
            .when(c["tag"] == "tr", T.row_title(page, x["link"]))
            .otherwise(T.default_title(page, c, x["link"], named))
        )

    linked = F.filter(C.with_links(page, C.default_candidates(page)), acceptable)
    return let(
        N.lookup(C.named_nodes(page.nodes)),
        lambda named: F.transform(
            linked,
            lambda x: F.struct(
                x["c"].alias("c"), x["link"].alias("link"), x["url"].alias("url"),
                title(x, named).alias("title"),
            ),
        ),
    )


@built_once
def _default_found(phase: str) -> Column:
    def keep(c: Column) -> Column:
        if phase == "both":
            return F.lit(True)
        return C.is_direct(c) if phase == "direct" else ~C.is_direct(c)

    def found(page: C.PageView) -> Column:
        valid = F.filter(
            titled_candidates(page),
            lambda x: keep(x["c"])
            & T.long_enough(x["title"])
            & (C.is_direct(x["c"]) | ~T.title_blocked(x["title"], DEFAULT_EXCLUDED_TITLES)),
        )
        return F.transform(
            valid,
            lambda x: F.struct(
                x["url"].alias("url"),
                _seq(x["c"]["code"], x["c"]["pre"]).alias("seq"),
                x["title"].alias("title"),
                F.when(C.is_direct(x["c"]), T.parent_text(page, x["c"]))
                .otherwise(page.text(x["c"])).alias("description"),
            ),
        )

    return _first_per(C.per_page(found), "url")


@built_once
def _titles_found() -> Column:
    return C.per_page(
        lambda page: F.transform(
            titled_candidates(page),
            lambda x: F.struct(
                x["c"]["code"].alias("code"), x["c"]["tag"].alias("tag"),
                x["c"]["pre"].alias("pre"), x["url"].alias("url"), x["title"].alias("title"),
            ),
        )
    )


def container_titles(shredded: DataFrame) -> DataFrame:
    """T1 and T2 as a table: title of every container and direct link with an acceptable URL,
    before titles are judged."""
    return shredded.select(*C.page_columns(shredded), F.inline(_titles_found()))


def container_postings(shredded: DataFrame) -> DataFrame:
    """Postings from containers, first valid one per page and URL."""
    return _rows(shredded, _default_found("containers"))


def direct_link_postings(shredded: DataFrame) -> DataFrame:
    """Postings from links that look like postings, wherever they stand. On its own it does
    not know what containers found; ``default_postings`` does."""
    return _rows(shredded, _default_found("direct"))


def default_postings(shredded: DataFrame) -> DataFrame:
    """Containers, then direct links with URLs not found yet. A container whose title is
    rejected does not claim its URL, so the direct link may still bring it in."""
    return _rows(shredded, _default_found("both"))


@built_once
def _custom_found() -> Column:
    """Postings of a page row that carries its board's rules and exclude lists."""

    def as_links(found: Column) -> Column:
        return F.transform(
            found,
            lambda a: C.span(a, a["in_chrome"].alias("in_chrome"), a["href"].alias("href")),
        )

    def postings(
        page: C.PageView, matched: Column, links: Column, titled: Column, described: Column
    ) -> Column:
        linked = F.transform(
            let(C.of_set(matched, "container"), C.winning_rank),
            lambda c: let(
                N.first_descendant(links, c),
                lambda link: F.struct(
                    c.alias("c"), link.alias("link"),
                    urls.resolve(link["href"], page.base_url).alias("url"),
                ),
            ),
        )
        acceptable = F.filter(
            linked,
            lambda x: F.coalesce(
                (x["url"] != "")
                & urls.is_http(x["url"])
                & ~url_blocked(x["url"], F.col("exclude_urls"))
                & ~urls.same_page(x["url"], page.base_url),
                F.lit(False),
            ),
        )
        named = F.transform(
            acceptable,
            lambda x: F.struct(
                x["url"].alias("url"),
                x["c"].alias("c"),
                T.custom_title(page, x["c"], x["link"], titled).alias("title"),
            ),
        )
        valid = F.filter(
            named,
            lambda x: T.long_enough(x["title"])
            & ~T.title_blocked(x["title"], F.col("exclude_titles")),
        )
        return F.transform(
            valid,
            lambda x: F.struct(
                x["url"].alias("url"), x["c"]["pre"].cast("long").alias("seq"),
                x["title"].alias("title"),
                T.rule_description(page, x["c"], described).alias("description"),
            ),
        )

    def found(page: C.PageView, matched: Column) -> Column:
        own_links = F.when(
            F.size("_link") > 0, N.lookup(as_links(C.of_set(matched, "link")))
        ).otherwise(page.links)
        return let(
            own_links,
            lambda links: let(
                N.lookup(C.of_set(matched, "title")),
                lambda titled: let(
                    N.lookup(C.of_set(matched, "description")),
                    lambda described: postings(page, matched, links, titled, described),
                ),
            ),
        )

    sets = {s: F.col(f"_{s}") for s in ("container", "link", "title", "description")}
    return _first_per(
        C.per_page(
            lambda page: let(
                C.matched_by_set(page.nodes, page.texts, **sets), lambda m: found(page, m)
            )
        ),
        "url",
    )


def custom_postings(
    shredded: DataFrame, boards: DataFrame, rules: DataFrame, *, small: bool | None = None
) -> DataFrame:
    """Postings by the rules of the board. Without container rules a board yields nothing."""
    lists = boards.select("board_id", "exclude_urls", "exclude_titles")
    pages = C.attach_rules(
        shredded, rules, "container", "link", "title", "description", settings=lists, small=small
    )
    return _rows(pages, _custom_found())


@built_once
def _frame_found() -> Column:
    rules = C.rules_literal(FRAME_CONTAINER_RULES)

    def usable(href: Column) -> Column:
        return F.coalesce(
            (href != "")
            & ~contains_any(href, FRAME_EXCLUDED_URLS)
            & (urls.slash_count(href) >= MIN_HREF_SLASHES),
            F.lit(False),
        )

    def body_text(page: C.PageView, blocks: Column, c: Column) -> Column:
        return let(
            N.first_descendant(blocks, c),
            lambda hit: F.when(hit.isNotNull(), page.text(hit)).otherwise(F.lit("")),
        )

    def found(page: C.PageView) -> Column:
        linked = F.filter(
            F.transform(
                C.matched_nodes(page.nodes, page.texts, rules),
                lambda c: F.struct(c.alias("c"), page.first_link(c).alias("link")),
            ),
            lambda x: usable(x["link"]["href"]),
        )
        titled = F.filter(
            F.transform(
                linked,
                lambda x: F.struct(
                    x["c"].alias("c"),
                    urls.resolve_in_frame(x["link"]["href"], page.base_url).alias("url"),
                    T.custom_title(page, x["c"], x["link"], None).alias("title"),
                ),
            ),
            lambda x: (word_count(x["title"]) >= MIN_TITLE_WORDS)
            & ~T.title_blocked(x["title"], FRAME_EXCLUDED_TITLES),
        )
        blocks = N.pick(page.nodes, lambda n: n["tag"].isin("p", "div"), "pre", "t_lo", "t_hi")
        return let(
            N.lookup(blocks),
            lambda b: F.transform(
                titled,
                lambda x: F.struct(
                    x["url"].alias("url"), x["title"].alias("title"),
                    (
                        F.shiftleft(F.col("frame_no").cast("long"), 40)
                        + _seq(F.array_min(x["c"]["ranks"]), x["c"]["pre"])
                    ).alias("seq"),
                    body_text(page, b, x["c"]).alias("description"),
                ),
            ),
        )

    return _first_per(C.per_page(found), "url", "title")


def frame_postings(shredded_frames: DataFrame) -> DataFrame:
    """Postings inside frame documents, first per frame, URL and title."""
    frames = C.job_frames(shredded_frames.filter(F.col("frame_no") > 0))
    return _rows(frames, _frame_found())


def navigation_postings(navigations: DataFrame) -> DataFrame:
    """Postings from a log of click outcomes; no deduplication, no title filter."""
    board = (
        F.col("board_id") if "board_id" in navigations.columns else F.lit(None).cast("long")
    )
    title = F.coalesce(
        F.nullif(strip(F.col("title_text")), F.lit("")), strip(F.col("container_text")), F.lit("")
    )
    return navigations.filter(
        (F.col("landed_url") != F.col("initial_url")) & ~F.endswith("landed_url", F.lit("/"))
    ).select(
        "page_id", board.alias("board_id"), F.col("seq").cast("long").alias("seq"),
        F.col("landed_url").alias("url"), title.alias("title"), title.alias("description"),
    )


def board_routes(boards: DataFrame) -> DataFrame:
    """Which flow each board takes. A scraping configuration, however small, means 'custom'. A
    ``route`` column of the boards, where not null, names the flow itself."""
    ruled = (
        F.when(F.col("has_scraping_config") & F.col("use_js_navigation"), "navigation")
        .when(F.col("has_scraping_config"), "custom")
        .when(F.col("use_iframe"), "frame")
        .otherwise("default")
    )
    named = F.coalesce("route", ruled) if "route" in boards.columns else ruled
    return boards.select("board_id", named.alias("route"))


def route_pages(pages: DataFrame, boards: DataFrame, *, small: bool | None = None) -> DataFrame:
    """Add ``route`` to rows that have a board_id. Store shredded pages partitioned by it and
    every flow below reads only its own part."""
    return lookup_join(
        pages, board_routes(boards), ["board_id"], "inner", spread_by=["page_id"], small=small
    )


BUILT_IN_ROUTES = ("default", "custom", "frame", "navigation")
Extractor = Callable[[DataFrame], DataFrame]


def route_postings(
    shredded: DataFrame,
    boards: DataFrame,
    rules: DataFrame,
    *,
    frames: DataFrame | None = None,
    navigations: DataFrame | None = None,
    extractors: dict[str, Extractor] | None = None,
    each: Extractor | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Each board's pages through its flow.

    Pages of frame boards whose frames give nothing fall back to the default flow. ``shredded``
    and ``frames`` may carry a ``route`` column already. ``extractors`` adds or replaces flows by
    route name (F1): any function from shredded pages to the postings columns. Boards take an added
    flow by their ``route`` column; a name without a flow is an error.

    ``each`` is applied to the postings of every flow where they arise, before any of them is moved
    (a run judges them there and drops the descriptions). It must keep ``page_id``. What frames give
    is stored once; if its pages are few enough to be broadcast they are struck out before the default
    flow reads them, else their postings are removed afterwards. Several flows read ``shredded``:
    store it first (``plans.run.stage_shredded``, ``stage_frames``), so that each document is parsed once.
    """
    if "route" in boards.columns:
        flows = [*BUILT_IN_ROUTES, *(extractors or {})]
        unknown = boards.filter(F.col("route").isNotNull() & ~F.col("route").isin(flows)).select("route").first()
        if unknown is not None:
            raise ValueError(f"no flow is named {unknown['route']!r}")
    if "route" not in shredded.columns:
        shredded = route_pages(shredded, boards, small=small)
    routes: dict[str, Extractor] = {
        "default": default_postings,
        "custom": lambda pages: custom_postings(pages, boards, rules, small=small),
        "frame": default_postings,
    }
    routes.update(extractors or {})
    finish = each or (lambda rows: rows)
    pages = {name: shredded.filter(F.col("route") == name).drop("route") for name in routes}
    inside, afterwards = None, False
    if frames is not None:
        if "route" not in frames.columns:
            frames = route_pages(frames, boards, small=small)
        inside = finish(frame_postings(frames.filter(F.col("route") == "frame").drop("route")))
        inside, seen = stored_with(inside, rows=F.count("*"))
        done = inside.select("page_id").distinct()
        afterwards = seen["rows"] > BROADCAST_ROWS
        if not afterwards:
            pages["frame"] = pages["frame"].join(F.broadcast(done), "page_id", "left_anti")
    parts = {name: flow(pages[name]).select(*POSTING_COLUMNS) for name, flow in routes.items()}
    finished = [] if inside is None else [inside]
    if afterwards:
        finished.append(finish(parts.pop("frame")).join(done, "page_id", "left_anti"))
    if navigations is not None and "navigation" not in (extractors or {}):
        if "route" not in navigations.columns:
            navigations = route_pages(navigations, boards, small=small)
        parts["navigation"] = navigation_postings(
            navigations.filter(F.col("route") == "navigation")
        )
    first, *others = parts.values()
    for part in others:
        first = first.unionByName(part)
    first = finish(first)
    for part in finished:
        first = first.unionByName(part)
    return first
