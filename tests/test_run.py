"""The full run: what moves, boards with long lists, frames, accounts of pages, added flows, failing boards."""

import re

import pytest
from pyspark.sql import functions as F

import documents as H
from boardwalk.operators import matching as M
from boardwalk.operators import paging as G
from boardwalk.operators.shredding import shred
from boardwalk.plans import extraction as X
from boardwalk.plans import run as R
from boardwalk.schemas import FRAMES
from helpers import HOME, board, boards, frames, pages, rules, shredded

NO_HISTORY = "url string"


def rows_of(run):
    return sorted((r["board_id"], r["url"], r["title"], r["dropped"], tuple(r["matched_keywords"])) for r in run.postings.collect())


def exchanged(df):
    """Columns that go into exchanges of a plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = set()
    for block in re.split(r"\n\n+", text):
        if re.match(r"\(\d+\) Exchange", block):
            found |= {c.split("#")[0].strip() for c in re.search(r"Input \[\d+\]: \[(.*?)\]", block).group(1).split(",")}
    return found


def test_no_exchange_holds_descriptions(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(R, "stored", lambda df: plans.append(df) or df)
    config = boards(spark, board(1, keywords=["bosun"]), board(2))
    R.run_boards(shred(pages(spark, H.LISTING, H.LISTING)), config, rules(spark))
    moved = exchanged(plans[-1])
    assert {"board_id", "url"} <= moved
    assert not moved & {"description", "nodes", "texts", "html", "_text"}


def _mixed(spark):
    many = [f"zz{k}" for k in range(200)]
    return boards(
        spark, board(1, keywords=["bosun"]), board(2, keywords=[*many, "Bosun", "+", "sea"]),
        board(3, keywords=["x"], location_filters=([*many, "cork"], ["ashore"])), board(4, keywords=many, location_filters=(None, ["bosun"])),
        board(5))


def test_boards_with_short_and_long_lists_in_one_run(spark, monkeypatch):
    shredded = shred(pages(spark, *[H.LISTING] * 5))
    universal = F.array(F.lit("Diver"))
    mixed = R.run_boards(shredded, _mixed(spark), rules(spark), universal, follow_pages=False)
    got = rows_of(mixed)
    monkeypatch.setattr(M, "SCAN_KEYWORDS", 10_000)
    alone = R.run_boards(shredded, _mixed(spark), rules(spark), universal, follow_pages=False)
    assert got == rows_of(alone)
    assert {r[0] for r in got if r[3]} >= {3, 4} and {r[0] for r in got if r[4]} >= {1, 2}
    assert sorted(map(tuple, mixed.funnel.collect())) == sorted(map(tuple, alone.funnel.collect()))
    monkeypatch.setattr(M, "SCAN_KEYWORDS", 0)
    assert rows_of(R.run_boards(shredded, _mixed(spark), rules(spark), universal, follow_pages=False)) == got


@pytest.mark.parametrize("bound", [500_000, 0])
def test_frames_strike_their_pages_out(spark, monkeypatch, bound):
    monkeypatch.setattr(X, "BROADCAST_ROWS", bound)
    config = boards(spark, board(3, use_iframe=True, keywords=["rigger", "bosun"]), board(4, use_iframe=True, keywords=["bosun"]), board(5))
    listing = shred(pages(spark, "", "", H.LISTING, H.LISTING, H.LISTING))
    frame = frames(spark, H.FRAME).withColumns({"board_id": F.lit(3).cast("long"), "page_id": F.lit(3).cast("long")})
    plain = X.route_postings(listing, config, rules(spark), frames=frame)
    run = R.run_boards(listing, config, rules(spark), frames=frame, follow_pages=False)
    assert {(r["board_id"], r["url"]) for r in plain.collect()} == {(r["board_id"], r["url"]) for r in run.postings.collect()}
    assert run.postings.filter("board_id = 3").count() == 2
    matched = {(r["board_id"], tuple(r["matched_keywords"])) for r in run.matches.collect()}
    assert (3, ("rigger",)) in matched and any(b == 4 for b, _ in matched)


def _crawl(spark):
    def page(there):
        return f'<a rel="next" href="{there}">next</a>' if there else ""

    rows = [(0, 1, HOME, page("?p=2")), (1, 1, HOME + "?p=2", page("?p=3")), (2, 1, HOME + "?p=3", ""), (3, 1, HOME + "/lost", ""),
            (4, 9, HOME, "")]
    return spark.createDataFrame(rows, "page_id long, board_id long, url string, html string")


def test_every_page_is_accounted_for(spark):
    config = boards(spark, board(1, max_pages=2))
    crawled = _crawl(spark)
    stray = spark.createDataFrame([(7, None)], "page_id long, board_id long")
    run = R.run_boards(shred(crawled), config, rules(spark), crawled=crawled.select("page_id", "board_id").unionByName(stray))
    why = {r["page_id"]: r["unreached"] for r in run.pages.collect()}
    assert why == {0: None, 1: None, 2: "no chain", 3: "no chain", 4: "board not listed", 7: "no board"}
    assert run.coverage == {"pages": 6, "reached": 2, "unreached": 4}
    assert [tuple(r) for r in run.funnel.select("pages", "unreached").collect()] == [(4, 2)]
    empty = R.run_boards(shred(crawled.limit(0)), config, rules(spark))
    assert empty.coverage == {"pages": 0, "reached": 0, "unreached": 0} and empty.postings.count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "stored_with", lambda df, **f: rounds.append(1) or _stored_with(df, **f))
    from boardwalk.session import stored_with as _stored_with
    n = F.col("id")
    url = F.concat(F.lit(HOME + "?p="), n.cast("string"))
    places = spark.range(400).select(n.alias("page_id"), F.floor(n / 200).cast("long").alias("board_id"), url.alias("url"))
    following = F.when(n == 230, 210).otherwise(n + 1).cast("string")  # board 1 turns back: a cycle
    edges = spark.range(400).select(n.alias("page_id"), F.concat(F.lit(HOME + "?p="), following).alias("next_url"))
    config = boards(spark, board(0, job_board_url=HOME + "?p=0", max_pages=150), board(1, job_board_url=HOME + "?p=200", max_pages=150))
    got = sorted((r["board_id"], r["page_no"], r["page_id"]) for r in G.page_chain(config, places, edges).collect())
    expected, at = [(0, k + 1, k) for k in range(150)], 200
    for k in range(150):
        expected.append((1, k + 1, at))
        at = 210 if at == 230 else at + 1
    assert got == expected
    assert len(rounds) == 9  # the first jumps, and eight doublings


def test_added_flows_in_a_run(spark):
    config = boards(spark, board(1, keywords=["bosun"]), board(2, keywords=["bosun"])).withColumn("route", F.expr("if(board_id = 2, 'loud', NULL)"))
    loud = lambda p: X.default_postings(p).withColumn("title", F.upper("title"))
    run = R.run_boards(shred(pages(spark, H.LISTING, H.LISTING)), config, rules(spark), extractors={"loud": loud}, follow_pages=False)
    assert {(1, "Bosun"), (2, "BOSUN")} <= {(r["board_id"], r["title"]) for r in run.postings.collect()}


def test_a_failing_board_leaves_the_others_as_they_are(spark):
    from boardwalk.operators.failures import SCHEMA

    def broken(rows):
        raise RuntimeError("no plan")

    route = F.expr("CASE board_id WHEN 2 THEN 'broken' WHEN 3 THEN 'nowhere' WHEN 4 THEN 'short' END")
    plain = boards(spark, *[board(k, keywords=["bosun"]) for k in range(1, 7)])
    shredded = shred(pages(spark, *[H.LISTING] * 6))
    flows = {"broken": broken, "short": lambda rows: rows.select("page_id")}
    told = spark.createDataFrame([(5, "configuration", "unreadable", True), (6, "selector", "left out", False)], SCHEMA)
    run = R.run_boards(shredded, plain.withColumn("route", route), rules(spark), extractors=flows, failures=told, follow_pages=False)
    alone = R.run_boards(shredded, plain.filter("board_id IN (1, 6)"), rules(spark), follow_pages=False)
    assert rows_of(run) == rows_of(alone) and rows_of(run)
    assert sorted(tuple(r)[:3] for r in run.failures.collect()) == [
        (2, "route", "flow broken: RuntimeError"), (3, "route", "no flow is named nowhere"),
        (4, "route", "flow short: AnalysisException"), (5, "configuration", "unreadable"), (6, "selector", "left out")]
    funnel = {r["board_id"]: r["listings"] for r in run.funnel.collect()}
    assert {k for k, n in funnel.items() if n == 0} == {2, 3, 4, 5} and len(funnel) == 6


@pytest.mark.parametrize("bound", [X.BROADCAST_ROWS, 0])
def test_staged_documents_are_parsed_once(spark, tmp_path, monkeypatch, bound):
    config = boards(spark, board(1), board(2, use_iframe=True), board(3, use_iframe=True))
    crawled = pages(spark, H.LISTING, H.LISTING, H.LISTING)
    inner = spark.createDataFrame(
        [(page, page, 1, "https://x.example.com/embed/list", H.FRAME) for page in (1, 2)], FRAMES)
    plain = X.route_postings(shred(crawled), config, rules(spark), frames=shred(inner))
    expected = sorted(map(str, plain.collect()))
    monkeypatch.setattr(X, "BROADCAST_ROWS", bound)
    staged = R.stage_shredded(crawled, config, str(tmp_path / "pages"))
    framed = R.stage_frames(inner, config, str(tmp_path / "frames"))
    assert [r["board_id"] for r in framed.collect()] == [2]  # no flow reads frames of other boards
    rows = X.route_postings(staged, config, rules(spark), frames=framed)
    assert sorted(map(str, rows.collect())) == expected
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    if bound:  # pages of frame boards are struck out where they lie, before postings arise
        assert re.search(r"BroadcastHashJoin \[page_id#\d+L\], \[page_id#\d+L\], LeftAnti", plan)


def test_lists_of_boards_are_built_once(spark, monkeypatch):
    """The length of a board's lists decides how it is judged; it is not worked out again at each use."""
    from boardwalk.plans import run as P

    seen = []

    def watched(rows, near, *args, **kinds):
        seen.append(near._jdf.queryExecution().optimizedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(P.M, "match_in_place", watched)
    own = boards(spark, board(1, keywords=["a", "b"])).distinct()
    with pytest.raises(StopIteration):
        P.run_boards(shredded(spark, "<p>x</p>").withColumn("route", F.lit("default")), own, rules(spark), follow_pages=False,
                     universal=F.array(F.lit("red")))
    assert seen and all("array_distinct" not in plan and "Aggregate" not in plan for plan in seen)
