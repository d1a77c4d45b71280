"""Small tables for tests."""

from boardwalk.functions.fixed import RULE_FIELDS
from boardwalk.operators.shredding import shred
from boardwalk.schemas import BOARDS, FRAMES, PAGES, POSTINGS, SELECTOR_RULES

HOME = "https://x.example.com/careers"


def pages(spark, *htmls, url=HOME):
    rows = [(i, i, url, h) for i, h in enumerate(htmls, 1)]
    return spark.createDataFrame(rows, PAGES)


def shredded(spark, *htmls, url=HOME):
    return shred(pages(spark, *htmls, url=url))


def frames(spark, *htmls, url="https://x.example.com/embed/list"):
    rows = [(1, 1, i, url, h) for i, h in enumerate(htmls, 1)]
    return shred(spark.createDataFrame(rows, FRAMES))


def board(board_id=1, **fields):
    row = dict(
        board_id=board_id, name=f"B{board_id}", job_board_url=HOME, keywords=[],
        location_filters=None, use_iframe=False, max_pages=10, has_scraping_config=False,
        use_js_navigation=False, exclude_urls=[], exclude_titles=[], pagination_selectors=None,
    )
    row.update(fields)
    return row


def boards(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in BOARDS.fields) for r in rows], BOARDS)


def rules(spark, *rows):
    """(rule_set, board_id, rule) triples."""
    return spark.createDataFrame(
        [(s, b, *[r[f] for f in RULE_FIELDS]) for s, b, r in rows], SELECTOR_RULES
    )


def postings(spark, *rows):
    return spark.createDataFrame(list(rows), POSTINGS)


def found(df):
    """(url path, title) of postings in page order."""
    rows = df.orderBy("page_id", "seq").collect()
    return [(r["url"].removeprefix("https://x.example.com"), r["title"]) for r in rows]
