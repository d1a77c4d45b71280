import documents as H
from pyspark.sql import functions as C

from boardwalk.functions.fixed import rule
from boardwalk.operators import paging as G
from boardwalk.operators.shredding import shred
from boardwalk.schemas import PAGES
from boardwalk.session import stored_with
from helpers import HOME, board, boards, rules, shredded


def next_urls(df):
    return {r["page_id"]: r["next_url"].removeprefix("https://x.example.com") for r in df.collect()}


def test_first_element_of_each_rule_only(spark):
    button = '<nav><button aria-label="Next">More</button></nav><a rel="next" href="/p2">next</a>'
    plain = '<div class="pagination"><a class="next" href="/p">forward</a></div>'
    load = '<a href="/more">Load more</a>'
    edges = G.next_page_edges(shredded(spark, H.PAGED, button, plain, load, "<p>none</p>"))
    # page 2: the accepted element is a button without href, which ends the chain
    assert next_urls(edges) == {1: "/careers?from=40", 4: "/more"}


def test_board_pagination_rules(spark):
    html = '<a class="fwd" href="/own">next</a><a rel="next" href="/default">next</a>'
    config = boards(
        spark, board(1), board(2, has_scraping_config=True, pagination_selectors=[]),
        board(3, has_scraping_config=True, pagination_selectors=["a.fwd"]),
        board(4, has_scraping_config=True, pagination_selectors=None),
        board(5, has_scraping_config=False, pagination_selectors=[]),
    )
    edges = G.next_page_edges(
        shredded(spark, *[html] * 5), config, rules(spark, ("pagination", 3, rule(0, "a", class_eq="fwd")))
    )
    assert next_urls(edges) == {1: "/default", 3: "/own", 4: "/default", 5: "/default"}


def crawl(spark, *links):
    """One board per chain of links: page URLs '', '1', ... and where each leads."""
    rows = []
    for page_id, (b, here, there) in enumerate(links):
        html = f'<a rel="next" href="{there}">next</a>' if there is not None else ""
        rows.append((page_id, b, HOME + here, html))
    return spark.createDataFrame(rows, PAGES)


def chain(spark, config, crawled):
    edges = G.next_page_edges(shred(crawled))
    rows = G.page_chain(config, crawled.select("page_id", "board_id", "url"), edges)
    return sorted((r["board_id"], r["page_no"], r["page_id"]) for r in rows.collect())


def test_chain_ends_cycles_and_limits(spark):
    crawled = crawl(
        spark, (1, "", "?p=2"), (1, "?p=2", "?p=3"), (1, "?p=3", None),
        (2, "", "?p=2"), (2, "?p=2", ""), (3, "", "/gone"), (4, "/else", None),
        (5, "", "?p=2"), (5, "?p=2", None),
    )
    config = boards(spark, board(1), board(2, max_pages=5), board(3), board(4), board(5, max_pages=1))
    expected = [
        (1, 1, 0), (1, 2, 1), (1, 3, 2),
        # an empty href is no next page, so board 2 does not come back
        (2, 1, 3), (2, 2, 4), (3, 1, 5), (5, 1, 7),
    ]
    assert chain(spark, config, crawled) == expected


def test_cycle_is_walked_to_the_limit(spark):
    crawled = crawl(spark, (1, "", "?p=2"), (1, "?p=2", "/careers"))
    rows = chain(spark, boards(spark, board(1, max_pages=5)), crawled)
    assert rows == [(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 1), (1, 5, 0)]


def test_no_boards_no_chain(spark):
    crawled = crawl(spark, (1, "", None))
    assert chain(spark, boards(spark, board(1, job_board_url="")), crawled) == []


def test_all_snapshots_redirects_and_moves(spark):
    crawled = crawl(
        spark, (1, "", None), (1, "", "?p=2"), (1, "?p=2", None), (2, "/landed", None), (3, "", None), (3, "/more", None),
    )
    config = boards(spark, board(1), board(2), board(3))
    pages = crawled.select("page_id", "board_id", "url").withColumn(
        "requested_url", C.when(C.col("board_id") == 2, C.lit(HOME)))
    edges = G.with_moves(G.next_page_edges(shred(crawled)), pages, spark.createDataFrame([(4, 5)], "page_id long, next_page_id long"))
    rows = G.page_chain(config, pages, edges)
    got = sorted((r["board_id"], r["page_no"], r["page_id"]) for r in rows.collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 1, 4), (3, 2, 5)]


def test_rounds_move_numbers_not_addresses(spark, monkeypatch):
    """What a round of the walk stores has no text in it, whatever the length of the addresses."""
    kinds = []

    def watched(df, **figures):
        kinds.append({f.dataType.simpleString() for f in df.schema.fields})
        return stored_with(df, **figures)

    monkeypatch.setattr(G, "stored_with", watched)
    place = "https://x.example.com/list?at={}".format
    pages = spark.createDataFrame([(i, 1, place(i)) for i in range(6)], "page_id long, board_id long, url string")
    edges = spark.createDataFrame([(1, place(i), i, place(i + 1)) for i in range(6)], "board_id long, url string, page_id long, next_url string")
    start = spark.createDataFrame([(1, place(1), 4)], "board_id long, job_board_url string, max_pages int")
    got = sorted(map(tuple, G.page_chain(start, pages, edges).collect()))
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4)]
    assert len(kinds) >= 2 and all("string" not in k for k in kinds)
