"""The full run: pages to report rows in one plan, and the staged variant for large inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.operators import history as H
from boardwalk.operators import matching as M
from boardwalk.operators import paging as G
from boardwalk.operators.boards import scrapable_boards
from boardwalk.operators.failures import all_failures, flow_failures, route_failures, stopped
from boardwalk.operators.shredding import shred
from boardwalk.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, lookup_join, row_bytes
from boardwalk.plans.extraction import BUILT_IN_ROUTES, POSTING_COLUMNS, Extractor, route_pages, route_postings
from boardwalk.session import stored, stored_with


def stage_shredded(pages: DataFrame, boards: DataFrame, path: str) -> DataFrame:
    """Shred pages once and store them by route; every flow then reads only its own part and
    the columns it needs. Worth it when several flows or pagination read the pages."""
    routed = route_pages(pages, boards)
    shred(routed).write.mode("overwrite").partitionBy("route").parquet(path)
    return pages.sparkSession.read.parquet(path)


def stage_frames(frames: DataFrame, boards: DataFrame, path: str) -> DataFrame:
    """Shred the frames of frame boards once and store them, with their route. Frames of other boards
    are read by no flow and are not parsed."""
    routed = route_pages(frames, boards).filter(F.col("route") == "frame")
    shred(routed).write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Run:
    """Tables of one run. ``postings`` has one row per board and URL with its flags. ``pages`` accounts
    for every crawled page (``paging.page_account``), and ``coverage`` counts them: ``pages`` is
    ``reached`` and ``unreached`` together. Both are None when pages are not followed. ``failures`` says
    what went wrong with single boards (``operators.failures``)."""

    postings: DataFrame
    matches: DataFrame
    funnel: DataFrame
    pages: DataFrame | None = None
    coverage: dict[str, int] | None = None
    failures: DataFrame | None = None


# a row of the long way to match, through the deduplication and back
_PLACE = ["board_id", "url", "page_id", "row_seq"]


def run_boards(
    shredded: DataFrame,
    boards: DataFrame,
    rules: DataFrame,
    universal: Column | None = None,
    *,
    page_moves: DataFrame | None = None,
    frames: DataFrame | None = None,
    navigations: DataFrame | None = None,
    history: DataFrame | None = None,
    follow_pages: bool = True,
    crawled: DataFrame | None = None,
    extractors: dict[str, Extractor] | None = None,
    failures: DataFrame | None = None,
) -> Run:
    """Route, judge, number and deduplicate the postings of all boards at once.

    Postings are judged where they arise: location and keywords need nothing but the posting and its
    board's lists. What is moved afterwards, once, for the deduplication, has flags instead of a
    description. That holds for boards whose lists are short (``matching.SCAN_KEYWORDS``); postings
    of the others are stored with their text, deduplicated without it, and judged by an index, so
    one run may have boards of both sorts. Look-up tables are measured once and broadcast within
    the bounds. ``shredded`` feeds several flows and should be stored (``stage_shredded``). The judged
    postings are stored: matches, funnel, history split and the sampling of the report sort all read
    them, and none of that may extract pages again.

    Universal keywords come from the boards' own column unless given. Without a history every match
    is new. ``page_moves`` are logged clicks on next-page buttons. Without ``follow_pages`` all pages
    count as one, and ``page_id`` says which of them is the last. ``crawled`` (page_id, board_id)
    lists pages to account for where ``shredded`` has fewer, as it has none without a board.
    ``extractors`` adds flows (``route_postings``).

    What is wrong with one board stays with it. Boards that ``failures`` (as of ``read_failures``) stops,
    whose route there is not, or whose added flow cannot be planned, contribute nothing and have zeros
    in the funnel; all others are as they would be without them.
    """
    boards = scrapable_boards(boards)
    listed_boards = boards
    known = [failures] if failures is not None else []
    if "route" in boards.columns:
        broken, extractors = flow_failures(boards, extractors or {}, shredded.drop("route"), POSTING_COLUMNS)
        known += [route_failures(boards.join(broken.select("board_id"), "board_id", "left_anti") if broken is not None else boards,
                                 [*BUILT_IN_ROUTES, *extractors]), *([] if broken is None else [broken])]
    failed = all_failures(*known) if known else None
    if failed is not None:
        failed = stored(failed)
        boards = boards.join(stopped(failed), "board_id", "left_anti")
    if universal is None:
        listed = "universal_keywords" in boards.columns
        universal = F.col("universal_keywords") if listed else F.array().cast("array<string>")
    # stored with the lengths of their lists: a filter on an expression goes down into the caller's plan,
    # and would build the lists of a board for every row the boards are made of, at every use
    sized = stored(boards.withColumn("_longest", M.longest_list(universal)))
    boards, few = sized.drop("_longest"), F.col("_longest") <= M.SCAN_KEYWORDS
    near, far = sized.filter(few).drop("_longest"), sized.filter(~few).drop("_longest")
    # what is broadcast of a board: its settings, and its lists if these are short
    settings = boards.drop("keywords", "location_filters", "universal_keywords")
    taken = row_bytes(settings) + F.when(few, row_bytes(boards.select("keywords", "location_filters"))).otherwise(0)
    shape = sized.agg(F.count("*").alias("rows"), F.sum(taken).alias("bytes"), F.count_if(~few).alias("far")).first()
    some_far = shape["far"] > 0
    if some_far:
        # few boards may have millions of keywords: these are made in as many tasks as a shuffle has
        far = stored(far.repartition(int(far.sparkSession.conf.get("spark.sql.shuffle.partitions")), "board_id"))
    small = shape["rows"] <= BROADCAST_ROWS and (shape["bytes"] or 0) <= BROADCAST_BYTES and fits_broadcast(rules)

    def judge(rows: DataFrame) -> DataFrame:
        judged = M.match_in_place(rows, near, universal, small=small)
        if some_far:
            mark = far.select("board_id", F.lit(True).alias("_far"))
            judged = lookup_join(judged, mark, ["board_id"], "left", spread_by=["url"], small=small).withColumns(
                {"_text": F.when(F.col("_far"), M.posting_text()), "row_seq": F.col("seq")}).drop("_far")
        return judged.drop("description")

    found = route_postings(
        shredded, boards, rules, frames=frames, navigations=navigations, extractors=extractors, each=judge, small=small
    )
    account = coverage = None
    if follow_pages:
        edges = G.next_page_edges(shredded, boards, rules, small=small)
        redirected = ["requested_url"] if "requested_url" in shredded.columns else []
        pages = shredded.select("page_id", "board_id", F.col("base_url").alias("url"), *redirected)
        if page_moves is not None:
            edges = G.with_moves(edges, pages, page_moves)
        chain = G.page_chain(boards, pages, edges)
        account, coverage = stored_with(
            G.page_account(boards, pages if crawled is None else crawled, chain),
            pages=F.count("*"), reached=F.count("page_no"), unreached=F.count("unreached"))
        found = G.number_pages(found, account)
    else:
        found = found.withColumn("page_no", F.lit(1))
    if some_far:
        found = stored(found)
    flagged = M.dedup_last(found.drop("_text"))
    if some_far:
        texts = found.filter(F.col("_text").isNotNull()).join(flagged.select(*_PLACE), _PLACE, "left_semi")
        texts = texts.dropDuplicates(_PLACE)
        verdicts = M.match_by_index(texts, far, universal, key=_PLACE, text="_text").select(
            *_PLACE, F.col("dropped").alias("_dropped"), F.col("matched_keywords").alias("_matched"))
        flagged = flagged.join(verdicts, _PLACE, "left").withColumns({
            "dropped": F.coalesce("_dropped", "dropped"), "matched_keywords": F.coalesce("_matched", "matched_keywords"),
        }).drop("_dropped", "_matched", "row_seq")
    flagged = stored(flagged)
    names = boards.select("board_id", F.col("name").alias("company"))
    matched = flagged.filter(F.size("matched_keywords") > 0).drop("dropped")
    matched = lookup_join(matched, names, ["board_id"], spread_by=["url"], small=small)
    if history is None:
        matched = matched.withColumn("section", F.lit("new"))
    else:
        matched = H.with_section(matched, history)
    funnel = M.board_funnel(
        listed_boards, flagged.withColumn("matched", F.size("matched_keywords") > 0), account
    )
    return Run(flagged, matched, funnel, account, coverage, failed)
