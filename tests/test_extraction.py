import pytest

import documents as H
from boardwalk.functions.fixed import rule
from boardwalk.operators import containers as C
from boardwalk.operators import skew
from boardwalk.operators.shredding import shred
from boardwalk.plans import extraction as X
from boardwalk.schemas import NAVIGATIONS
from helpers import HOME, board, boards, found, frames, pages, rules, shredded


def default(spark, html, url=HOME):
    return found(X.default_postings(shredded(spark, html, url=url)))


def test_wrapper_wins(spark):
    rows = X.default_postings(shredded(spark, H.LISTING)).orderBy("seq").collect()
    assert [r["url"].rpartition("/")[2] for r in rows] == ["cook?berth=2", "watch", "purser", "bosun"]
    first, watch, purser, bosun = rows
    assert first["title"] == "Ship's cook"
    assert first["description"].startswith("Ship's cook Galley of eight")
    assert first["description"].endswith("Keeps the books Hull")  # text of the whole listing
    # an item that is never closed holds the next one
    assert watch["description"] == "Night watch Two weeks on, two off Purser Keeps the books Hull"
    assert purser["description"] == "Purser Keeps the books Hull"
    assert bosun["description"] == "Bosun Ropes and paint. Narvik"


def test_container_order_and_first_wins(spark):
    html = (
        '<div class="position"><a href="/jobs/1">from div</a></div>'
        '<article id="jobs"><a href="/jobs/1">from article</a></article>'
        '<li class="role"><a href="/jobs/2">by role</a></li>'
        '<li data-testid="job"><a href="/jobs/2">by job</a></li>'
    )
    assert default(spark, html) == [("/jobs/1", "from article"), ("/jobs/2", "by job")]


def test_rejected_titles_do_not_claim_urls(spark):
    html = (
        '<div class="job"><h3>Join our team</h3><a href="/jobs/1">Real title</a></div>'
        '<div class="job"><h3></h3><a href="/jobs/2">Empty heading is final</a></div>'
        '<div class="job"><a href="/jobs/3">ab</a></div>'
    )
    assert default(spark, html) == [
        ("/jobs/1", "Real title"), ("/jobs/2", "Empty heading is final"),
    ]
    only = X.container_postings(shredded(spark, html))
    assert found(only) == []


def test_url_filters(spark):
    def card(href, title):
        return f'<div class="job"><a href="{href}">{title}</a></div>'

    html = (
        card("?page=2", "same page") + card("mailto:a@example.com", "mail") + card("", "empty href")
        + card("/about", "no pattern") + card("https://o.example.org/x", "other host")
        + card("/jobs/search", "search page") + card("/JOBS/9", "case does not matter")
        + card("//cdn.example.net/role", "scheme relative")
        + '<div class="job"><a href="">first link is empty</a><a href="/jobs/8">never tried</a></div>'
        + '<footer><div class="job"><a href="/jobs/7">footer</a></div></footer>'
    )
    assert found(X.container_postings(shredded(spark, html))) == [
        ("https://o.example.org/x", "other host"), ("/JOBS/9", "case does not matter"),
        ("https://cdn.example.net/role", "scheme relative"),
    ]
    # the search filter is not applied to direct links, and they need no container
    assert ("/jobs/search", "search page") in default(spark, html)
    assert ("/jobs/8", "never tried") in default(spark, html)


def test_default_title_fallbacks(spark):
    long = "word " * 40
    html = (
        '<div class="job"><a href="/jobs/1"><img></a><span class="JobName">Named</span></div>'
        f'<div class="job"><a href="/jobs/2"></a><b>{long}</b></div>'
        '<div class="job"><a href="/jobs/3"></a><b>Line one\n two</b></div>'
        '<div class="job"><a href="/jobs/4"></a><p class="title"></p><b>not reached</b></div>'
    )
    assert default(spark, html) == [
        ("/jobs/1", "Named"), ("/jobs/2", long[:100].strip()), ("/jobs/3", "Line one"),
    ]


def test_table_rows(spark):
    html = """<table>
<tr><td><h4>Heading</h4><a href="/jobs/1">go</a></td><td>Berlin</td></tr>
<tr><td>Cell text</td><td><a href="/jobs/2">Link text</a></td></tr>
<tr><td><a href="/jobs/3"></a>Cell only</td><td>somewhere</td></tr>
<tr><td><a href="#x">no</a></td><td>unusable link, long enough</td></tr>
<tr><td><a href="/jobs/5">tiny</a></td></tr>
</table><tr><td><a href="/role/6">outside any table</a></td></tr>"""
    rows = C.row_containers(shredded(spark, html)).orderBy("pre").collect()
    assert [r["href"] for r in rows] == ["/jobs/1", "/jobs/2", "/jobs/3"]
    assert default(spark, html)[:3] == [
        ("/jobs/1", "Heading"), ("/jobs/2", "Link text"), ("/jobs/3", "Cell only"),
    ]


def test_result_items(spark):
    html = (
        '<li data-qa="searchResultItem"><a href="/jobs/1">First</a></li>'
        '<div data-qa="eventResultItem"><a href="https://o.example.org/e">Event</a></div>'
        '<div data-qa="xResultItem"><a href="/jobs/2">Second</a></div>'
    )
    codes = C.result_item_containers(shredded(spark, html)).orderBy("code").collect()
    assert [(r["code"], r["href"]) for r in codes] == [(108, "/jobs/1"), (110, "/jobs/2")]
    assert default(spark, html) == [("/jobs/1", "First"), ("/jobs/2", "Second")]


def test_direct_link_description_and_chrome(spark):
    html = '<p>About <a href="/jobs/1">Cook</a> now</p><nav><a href="/jobs/2">Nav job</a></nav>'
    rows = X.direct_link_postings(shredded(spark, html)).collect()
    assert [(r["title"], r["description"]) for r in rows] == [("Cook", "About Cook now")]
    top = X.direct_link_postings(shredded(spark, 'x <a href="/role/1">Top level</a> y')).first()
    assert top["description"] == "x Top level y"


CUSTOM_RULES = [
    ("container", 1, rule(0, "div", class_eq="missing")),
    ("container", 1, rule(1, "dt", class_eq="berth")),
    ("title", 1, rule(0, "strong")),
    ("description", 1, rule(0, class_eq="terms")),
]


def custom(spark, html, *rows, **fields):
    config = boards(spark, board(has_scraping_config=True, **fields))
    return X.custom_postings(shredded(spark, html), config, rules(spark, *rows))


def test_custom_rules(spark):
    rows = custom(spark, H.CUSTOM, *CUSTOM_RULES).orderBy("seq").collect()
    assert [(r["title"], r["description"]) for r in rows] == [
        ("Stoker", "Hot work, Leith"), ("Diver", "Cold work, Oban"), ("Harbour Pilot", "Mull, summers"),
    ]
    assert custom(spark, H.CUSTOM).count() == 0  # no container rules, no postings
    kept = custom(
        spark, H.CUSTOM, *CUSTOM_RULES, exclude_urls=["/stoker-", "berths$"], exclude_titles=["diver", "Pilot"]
    )
    assert found(kept) == [("/berths/pilot-1", "Harbour Pilot")]  # capitals never hit


def test_custom_link_rule_and_shared_rules(spark):
    html = (
        '<nav class="x"><div class="c"><a href="/1">in chrome</a></div></nav>'
        '<div class="c"><a href="/skip">skip</a><span class="go" href="/jobs/2"></span><h5>Head</h5></div>'
        '<div class="c"><a href="/skip">no match for the link rule</a></div>'
    )
    shared = [("container", None, rule(0, class_eq="c")), ("link", None, rule(0, attr="href", op="^=", value="/J", ci=True))]
    assert found(custom(spark, html, *shared)) == [("/jobs/2", "Head")]


def test_selector_conditions(spark):
    html = (
        '<ul class="pagination x"><li><a class="next">1</a></li></ul><a class="next">2</a>'
        '<nav aria-label="Pagination"><a>3</a><a>4</a></nav><p id="a">Find ME</p>'
    )
    picks = [
        rule(0, "a", class_eq="next", ancestor_tag="ul", ancestor_class="pagination"),
        rule(1, "a", last_child=True, ancestor_tag="nav", ancestor_attr="aria-label",
             ancestor_op="*=", ancestor_value="pagination", ci=True),
        rule(2, id_eq="a", has_text="find me"),
        rule(3, attr="class", op="$=", value="x"),
        rule(4, attr="class", op="exists", tag="a"),
        rule(4, "a", class_eq="next"),
    ]
    rows = C.select_elements(shredded(spark, html), picks).orderBy("rank", "pre").collect()
    assert [(r["rank"], r["text"]) for r in rows] == [
        (0, "1"), (1, "4"), (2, "Find ME"), (3, "1"), (4, "1"), (4, "2"),
    ]


def test_frames(spark):
    rows = X.frame_postings(frames(spark, H.FRAME)).orderBy("seq").collect()
    assert [(r["title"], r["description"]) for r in rows] == [
        ("Master Sailmaker", "Loft in Cork, a role ashore"), ("Junior Rigger", "Afloat"),
    ]
    nothing = '<div class="opening"><a href="/a/b/c/d">Two words</a></div>'
    html = (
        "<p>jobs</p>"
        '<div class="opening"><a href="/a/b/c/d">Two words</a></div>'
        '<nav><section class="level-0"><a href="x/a/b/c/d">In chrome</a></section></nav>'
        '<div id="job1"><a href="/a/b/c/e">Single</a></div>'
        '<div id="job2"><a href="/a/b/c#f">Has fragment</a></div>'
        '<div id="job3"><a href="/jobs/1">Too shallow</a></div>'
        '<div id="job4"><a href="/a/b/c/d">Apply right here</a></div>'
        '<div id="job5"><a href="/a/b/c/d">Two words</a></div>'
    )
    rows = X.frame_postings(frames(spark, nothing.replace("opening", "level"), html))
    assert found(rows) == [
        ("/a/b/c/d", "Two words"), ("/embed/x/a/b/c/d", "In chrome"),
    ]
    assert rows.first()["description"] == ""


def test_routes(spark):
    config = boards(
        spark,
        board(1), board(2, has_scraping_config=True), board(3, use_iframe=True),
        board(4, use_iframe=True), board(5, has_scraping_config=True, use_js_navigation=True),
    )
    listing = [H.LISTING, H.CUSTOM, H.LISTING, H.LISTING, H.LISTING]
    frame = frames(spark, H.FRAME).withColumn("board_id", C.F.lit(3).cast("long")).withColumn(
        "page_id", C.F.lit(3).cast("long")
    )
    clicks = spark.createDataFrame(
        [(5, 5, i, HOME, f" T{i} ", "text", u) for i, u in
         enumerate([HOME, HOME + "/", HOME + "/qa", HOME + "/qa"])], NAVIGATIONS
    )
    picks = [(s, 2, r) for s, _, r in CUSTOM_RULES]
    rows = X.route_postings(
        shred(pages(spark, *listing)), config, rules(spark, *picks), frames=frame, navigations=clicks
    )
    counts = {r["board_id"]: r["count"] for r in rows.groupBy("board_id").count().collect()}
    assert counts == {1: 4, 2: 3, 3: 2, 4: 4, 5: 2}
    assert {r["title"] for r in rows.filter("board_id = 5").collect()} == {"T2", "T3"}


def test_unbounded_lookup_gives_the_same_with_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLED", 1.0)  # so that the only board is seen to be heavy
    config = boards(spark, board(1, has_scraping_config=True, exclude_titles=["diver"]))
    picks = rules(spark, *CUSTOM_RULES)
    near = X.custom_postings(shredded(spark, H.CUSTOM), config, picks, small=True)
    far = X.custom_postings(shredded(spark, H.CUSTOM), config, picks, small=False)
    assert found(near) == found(far) and len(found(far)) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = X.custom_postings(shredded(spark, H.CUSTOM), config, picks, small=False)
        plan = far._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pages_side = [line for line in plan.splitlines() if "Exchange hashpartitioning(board_id" in line and "_salt" in line]
    assert len(pages_side) == 2  # page rows once, the lookup table once


def test_added_flows_and_items_with_keywords(spark):
    config = boards(spark, board(1), board(2)).withColumn("route", C.F.expr("if(board_id = 2, 'loud', NULL)"))
    loud = lambda p: X.default_postings(p).withColumn("title", C.F.upper("title"))
    none = rules(spark)
    rows = X.route_postings(shred(pages(spark, H.LISTING, H.LISTING)), config, none, extractors={"loud": loud})
    titles = {(r["board_id"], r["title"]) for r in rows.collect()}
    assert {(1, "Bosun"), (2, "BOSUN")} <= titles and len(titles) == 8
    with pytest.raises(ValueError, match="loud"):
        X.route_postings(shred(pages(spark, H.LISTING)), config, none)
    html = '<li class="job" data-qa="searchResultItem"><a href="/jobs/1">Both kinds</a></li>'
    assert C.result_item_containers(shredded(spark, html)).count() == 1
    assert C.keyword_containers(shredded(spark, html)).count() == 1
