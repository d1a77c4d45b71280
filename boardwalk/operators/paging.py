"""Next-page links of crawled pages, and the chain of pages of each board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import nodes as N
from boardwalk.functions import urls
from boardwalk.functions.binding import built_once, let
from boardwalk.functions.fixed import MAX_PAGES, NEXT_PAGE_RULES, NEXT_PAGE_WORDS
from boardwalk.functions.text import contains_any
from boardwalk.operators import containers as C
from boardwalk.session import stored, stored_with


def _next_url(nodes: Column, texts: Column, base_url: Column, found: Column) -> Column:
    """URL of the first accepted element: rules in rank order, only the first element of each."""

    def first_of(items: Column, rank: Column) -> Column:
        return F.get(F.filter(items, lambda n: F.array_contains(n["ranks"], rank)), F.lit(0))

    def accepted(items: Column, rank: Column) -> Column:
        text = F.lower(N.subtree_text(texts, first_of(items, rank)))
        return contains_any(text, NEXT_PAGE_WORDS)

    def choose(items: Column) -> Column:
        ranks = F.array_sort(
            F.array_distinct(F.flatten(F.transform(items, lambda n: n["ranks"])))
        )
        winner = F.get(F.filter(ranks, lambda r: accepted(items, r)), F.lit(0))
        return let(winner, lambda r: urls.resolve(first_of(items, r)["href"], base_url))

    return let(found, choose)


@built_once
def _next_found(listed: str) -> Column:
    """Next URL of a page row: by the default rules, or where ``_own`` is set by the rules in
    ``_pagination`` ('rules') or by none ('off')."""
    nodes, texts = F.col("nodes"), F.col("texts")
    clickable = F.filter(nodes, lambda n: n["tag"].isin("a", "button"))
    found = C.matched_nodes(nodes, texts, C.rules_literal(NEXT_PAGE_RULES), among=clickable)
    if listed == "off":
        found = F.when(~F.coalesce("_own", F.lit(False)), found)
    if listed == "rules":
        own = C.matched_nodes(nodes, texts, F.col("_pagination"))
        found = F.when(F.coalesce("_own", F.lit(False)), own).otherwise(found)
    return _next_url(nodes, texts, F.col("base_url"), found)


def next_page_edges(
    shredded: DataFrame,
    boards: DataFrame | None = None,
    rules: DataFrame | None = None,
    *,
    small: bool | None = None,
) -> DataFrame:
    """G1: (board_id, url, page_id, next_url), pages without a next page left out.

    A board whose configuration lists pagination rules uses only those; an empty list turns
    pagination off. A first accepted element without an href ends the chain, because a snapshot
    does not show where a click leads.
    """
    pages, listed = shredded, ""
    if boards is not None:
        lists = boards.select(
            "board_id",
            (F.col("has_scraping_config") & F.col("pagination_selectors").isNotNull()).alias("_own"),
        )
        pages = C.attach_rules(pages, rules, "pagination", settings=lists, small=small)
        listed = "off" if rules is None else "rules"
    board = F.col("board_id") if "board_id" in shredded.columns else F.lit(None).cast("long")
    # a generator, because a filter would evaluate the expression a second time
    following = F.filter(F.array(_next_found(listed)), lambda u: u != "")
    return pages.select(
        board.alias("board_id"), F.col("base_url").alias("url"), "page_id",
        F.explode(following).alias("next_url"),
    )


def with_moves(edges: DataFrame, pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with the outcomes of clicks, ``(page_id, next_page_id)``, a crawler logged: they come
    before what the snapshot shows, and give buttons without a URL of their own a next page."""
    targets = pages.select(F.col("page_id").alias("next_page_id"), F.col("url").alias("next_url"))
    logged = (moves.select("page_id", "next_page_id").join(targets, "next_page_id")
              .groupBy("page_id").agg(F.min("next_url").alias("next_url")))
    known = pages.select("page_id", "board_id", "url").join(logged, "page_id")
    columns = ["board_id", "url", "page_id", "next_url"]
    return edges.join(logged, "page_id", "left_anti").select(*columns).unionByName(known.select(*columns))


def _addresses(pages: DataFrame) -> DataFrame:
    """(board_id, page_id, address): a page stands for its URL and the one that led to it."""
    both = F.array("url", "requested_url") if "requested_url" in pages.columns else F.array("url")
    return pages.select(
        "board_id", "page_id", F.explode(F.array_distinct(F.array_compact(both))).alias("address")
    )


# a round stores (max_pages, origin, node, page_no): jumps have an origin, visits a page_no


def _jumps(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("origin").isNotNull())


def _visits(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("page_no").isNotNull())


def page_chain(boards: DataFrame, pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(board_id, page_id, page_no) of every visit, starting at the board's URL.

    ``pages`` is (page_id, board_id, url) and, where a crawler was redirected, ``requested_url``: a
    page stands for both addresses. All snapshots of one address take part in a visit; its next page
    is that of the earliest snapshot that has one. A chain ends without a next page, at a page that
    was not crawled, or after the board's ``max_pages``; a cycle is walked until that limit.

    The chains of all boards grow by doubling. Round k knows the visits 1 to 2**k of every chain and
    for each address the one 2**k pages on; one join with these jumps gives the next visits and, jump
    after jump, the jumps of twice the length. So 150 pages take eight rounds. Jumps that lead out of
    a chain or past its limit are dropped, which leaves fewer each round; a round without any, or
    without a new visit, is the last. Rounds move the numbers of addresses, not the addresses. Each round is stored, so plans stay small and a lost executor
    costs no finished round.
    """
    places = _addresses(pages)
    starts = boards.select(
        "board_id", F.col("job_board_url").alias("address"),
        F.coalesce("max_pages", F.lit(MAX_PAGES)).alias("max_pages"),
    ).filter((F.coalesce("address", F.lit("")) != "") & (F.col("max_pages") >= 1))
    led = places.join(edges.select("page_id", "next_url"), "page_id", "left")
    # the earliest snapshot that has a next page; stored, so a number stays that of its address
    nodes = stored(led.groupBy("board_id", "address").agg(
        F.min_by("next_url", F.when(F.col("next_url").isNotNull(), F.col("page_id"))).alias("next_url")
    ).withColumn("node", F.monotonically_increasing_id()))
    known_at = nodes.select("board_id", "address", "node")
    none = F.lit(None)
    origins = nodes.select("board_id", F.col("next_url").alias("address"), F.col("node").alias("origin")).filter("address IS NOT NULL")
    jumps = origins.join(starts.select("board_id", "max_pages"), "board_id").filter("max_pages > 1").join(
        known_at, ["board_id", "address"]).select("max_pages", "origin", "node", none.cast("int").alias("page_no"))
    first = starts.join(known_at, ["board_id", "address"]).select(
        "max_pages", none.cast("long").alias("origin"), "node", F.lit(1).alias("page_no"))
    figures = {"jumps": F.count("origin"), "visits": F.count("page_no")}
    known, seen = stored_with(jumps.unionByName(first), **figures)
    visits, width = _visits(known), 1
    while seen["jumps"] and seen["visits"]:
        here = _jumps(known)
        # a jump goes on where it ends, a visit where it is; only what stays within the limit
        asked = here.filter(F.col("max_pages") > 2 * width).unionByName(
            visits.filter(F.col("max_pages") >= F.col("page_no") + width))
        onward = here.select(F.col("origin").alias("node"), F.col("node").alias("_after"))
        found = asked.join(onward, "node").select(
            "max_pages", "origin", F.col("_after").alias("node"), (F.col("page_no") + width).alias("page_no"))
        known, seen = stored_with(found, **figures)
        visits, width = visits.unionByName(_visits(known)), 2 * width
    came = visits.select("node", "page_no").join(known_at, "node")
    return came.join(places, ["board_id", "address"]).select("board_id", "page_id", "page_no").distinct()


def page_account(boards: DataFrame, pages: DataFrame, chain: DataFrame) -> DataFrame:
    """One row (page_id, board_id, page_no, first_page_no, unreached) for each crawled page.

    ``page_no`` is the last visit of the page, ``first_page_no`` the first. A page without a visit
    says in ``unreached`` why: 'no board' when none was found for it, 'board not listed' when its
    board is not among ``boards``, 'no chain' when no chain of its board comes to it.
    """
    visits = chain.groupBy("board_id", "page_id").agg(
        F.max("page_no").alias("page_no"), F.min("page_no").alias("first_page_no")
    )
    listed = boards.select("board_id", F.lit(True).alias("_listed"))
    rows = pages.select("page_id", "board_id").join(listed, "board_id", "left").join(
        visits, ["board_id", "page_id"], "left")
    why = (
        F.when(F.col("page_no").isNotNull(), F.lit(None)).when(F.col("board_id").isNull(), "no board")
        .when(F.col("_listed").isNull(), "board not listed").otherwise("no chain")
    )
    return rows.select("page_id", "board_id", "page_no", "first_page_no", why.alias("unreached"))


def unreached_pages(boards: DataFrame, pages: DataFrame, chain: DataFrame) -> DataFrame:
    """The crawled pages whose postings take no part in a run: (page_id, board_id, unreached)."""
    account = page_account(boards, pages, chain)
    return account.filter(F.col("unreached").isNotNull()).select("page_id", "board_id", "unreached")


def number_pages(postings: DataFrame, visits: DataFrame) -> DataFrame:
    """Give postings the first and the last visit of their page. The last one decides which
    values win, the first one the position, so revisited pages need no repeated postings.

    ``visits`` is a chain, or an account with one row per page; both have rows without descriptions,
    and so should ``postings``, as both sides may be moved."""
    if "first_page_no" not in visits.columns:
        visits = visits.groupBy("board_id", "page_id").agg(
            F.max("page_no").alias("page_no"), F.min("page_no").alias("first_page_no")
        )
    numbered = visits.filter(F.col("page_no").isNotNull()).select("board_id", "page_id", "page_no", "first_page_no")
    return postings.join(numbered, ["board_id", "page_id"])
