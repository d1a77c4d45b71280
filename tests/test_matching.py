import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardwalk.operators import boards as K
from boardwalk.operators import matching as M
from helpers import board, boards

ROWS = "board_id long, url string, title string, description string, page_no int, seq long"


def postings(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def python_hits(title, description, keywords):
    text = f"{title} {description}".lower()
    return {k for k in keywords if re.search(r"\b" + re.escape(k.lower()) + r"\b", text)}


def test_dedup_keeps_last_values_and_first_position(spark):
    rows = postings(
        spark, (1, "u1", "old", "a", 1, 1), (1, "u2", "two", "b", 1, 2), (1, "u1", "new", "c", 2, 1),
        (2, "u1", "other board", "d", 1, 1), (1, "u3", "three", "e", 2, 2), (1, "u1/", "slash", "f", 2, 3),
    )
    out = M.dedup_last(rows).orderBy("board_id", "page_no", "seq")
    assert [tuple(r[c] for c in ("board_id", "url", "title", "page_no", "seq")) for r in out.collect()] == [
        (1, "u1", "new", 1, 1), (1, "u2", "two", 1, 2), (1, "u3", "three", 2, 2),
        (1, "u1/", "slash", 2, 3), (2, "u1", "other board", 1, 1),
    ]
    again = M.dedup_last(M.dedup_last(rows))
    assert sorted(map(str, again.select("url", "title").collect())) == sorted(
        map(str, out.select("url", "title").collect())
    )


def test_dedup_with_revisited_pages(spark):
    rows = postings(spark, (1, "u", "first page", "", 3, 1), (1, "u", "second page", "", 2, 1))
    rows = rows.withColumn("first_page_no", F.when(F.col("page_no") == 3, 1).otherwise(2))
    row = M.dedup_last(rows).first()
    assert (row["title"], row["page_no"]) == ("first page", 1)


def test_dedup_of_a_hot_url(spark):
    hot = spark.range(9000).select(
        F.lit(1).cast("long").alias("board_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.col("id").cast("string").alias("title"), F.lit("").alias("description"),
        (F.col("id") % 10).alias("page_no"), F.col("id").alias("seq"),
    )
    out = M.dedup_last(hot)
    assert out.count() == 6001
    last = max((i for i in range(0, 9000, 3)), key=lambda i: (i % 10, i))
    assert out.filter("url = 'hot'").first()["title"] == str(last)


LOCATION_CASES = [
    (None, True), ({}, True), ({"include": ["REMOTE, us"]}, True), ({"include": ["berlin"]}, False),
    ({"include": ["berlin", "us"]}, True), ({"include": [""]}, False), ({"include": []}, True),
    ({"exclude": ["Remote"]}, False), ({"exclude": ["", "berlin"]}, True),
    ({"include": ["us"], "exclude": ["dev"]}, False), ({"include": ["us"], "exclude": []}, True),
]


def test_location_filter(spark):
    rows = [board(i, location_filters=None if f is None else (f.get("include"), f.get("exclude")))
            for i, (f, _) in enumerate(LOCATION_CASES)]
    jobs = postings(spark, *[(i, "u", "Dev", "Remote, US", 1, 1) for i in range(len(rows))])
    kept = {r["board_id"] for r in M.location_filter(jobs, boards(spark, *rows)).collect()}
    assert kept == {i for i, (_, keep) in enumerate(LOCATION_CASES) if keep}


def test_keyword_cases(spark):
    words = ["Go", "c++", "machine learning", "été", "", ".net", "remote, us"]
    texts = ["Golang Developer", "Go Developer", "c++ dev", "c++dev", "Machine Learning.", "été",
             "machine  learning", "a.NET", "remote, us", "..."]
    jobs = postings(spark, *[(1, str(i), t, "", 1, i) for i, t in enumerate(texts)])
    config = boards(spark, board(1, keywords=words))
    keywords = K.board_keywords(config, F.array().cast("array<string>"))
    expected = {(str(i), k.lower()) for i, t in enumerate(texts) for k in python_hits(t, "", words)}
    for strategy in ("scan", "token"):
        for small in (True, False):
            hits = M.keyword_hits(jobs, keywords, strategy=strategy, small=small).collect()
            assert sorted((r["url"], r["keyword"]) for r in hits) == sorted(expected), (strategy, small)
    in_place = M.match_in_place(jobs, config, F.array().cast("array<string>")).collect()
    assert {(r["url"], k) for r in in_place for k in r["matched_keywords"]} == expected


CHARS = "ab_é́+. "


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet=CHARS, max_size=12), min_size=8, max_size=15),
    st.lists(st.text(alphabet=CHARS, max_size=4), min_size=4, max_size=9, unique=True),
)
def test_all_ways_to_match_agree(spark, texts, words):
    jobs = postings(spark, *[(1, str(i), t, "", 1, i) for i, t in enumerate(texts)])
    keywords = spark.createDataFrame([(1, w) for w in words], "board_id long, keyword string")
    expected = sorted(
        (str(i), k) for i, t in enumerate(texts) if t
        for k in python_hits(t, "", words)
    )
    before = M.SCAN_KEYWORDS
    try:
        for limit in (before, 1):  # 1: phrases are looked up by their longest word
            M.SCAN_KEYWORDS = limit
            for strategy in ("scan", "token"):
                hits = M.keyword_hits(jobs, keywords, strategy=strategy).collect()
                # a posting without any text is skipped before it is looked at
                got = sorted((r["url"], r["keyword"]) for r in hits if texts[int(r["url"])])
                assert got == expected, (limit, strategy)
    finally:
        M.SCAN_KEYWORDS = before


def test_matches_and_funnel(spark):
    config = boards(
        spark, board(1, keywords=["QA"], location_filters=([], ["canada"])), board(2, keywords=["qa"]), board(3),
    )
    jobs = postings(
        spark, (1, "a", "QA lead", "", 1, 1), (1, "b", "QA", "Canada", 1, 2), (1, "c", "Cook", "", 1, 3),
        (3, "d", "qa", "no keywords on this board", 1, 1),
    )
    universal = F.array(F.lit("Lead"))
    rows = M.matches(M.location_filter(jobs, config), K.board_keywords(config, universal).filter("board_id < 3"))
    assert [(r["url"], r["matched_keywords"]) for r in rows.collect()] == [("a", ["lead", "qa"])]
    flagged = M.match_in_place(jobs, config, universal).withColumn("matched", F.size("matched_keywords") > 0)
    funnel = {r["board_id"]: (r["listings"], r["dropped"], r["matched"]) for r in M.board_funnel(config, flagged).collect()}
    assert funnel == {1: (3, 1, 1), 2: (0, 0, 0), 3: (1, 0, 0)}


def test_board_operators(spark):
    config = boards(spark, board(1, name="Acme"), board(2, name="ACME"), board(3, name="Other", job_board_url=""))
    assert {r["board_id"] for r in K.select_boards(config, "acme").collect()} == {1, 2}
    with pytest.raises(ValueError, match="Acme.*Other"):
        K.select_boards(config, "none")
    assert {r["board_id"] for r in K.scrapable_boards(config).collect()} == {1, 2}
    assert K.append_boards(config, config).count() == 6
    lists = spark.createDataFrame([(1, "a, b ,,c  d"), (2, " , "), (3, "one")], "id int, text string")
    got = K.clean_keyword_lists(lists, "text").orderBy("id", "pos").collect()
    assert [(r["id"], r["keyword"]) for r in got] == [(1, "a"), (1, "b"), (1, "c  d"), (3, "one")]
    old = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, keyword string")
    new = spark.createDataFrame([(0, "A"), (1, "b"), (2, "c"), (3, "c")], "pos int, keyword string")
    merged = K.merge_universal(old, new).orderBy("part", "pos").collect()
    assert [r["keyword"] for r in merged] == ["b", "a", "A", "c"]


def test_repeated_rows_give_the_same_hits_every_way(spark):
    phrases = [f"w{k} x{k}" for k in range(M.SCAN_KEYWORDS + 7)] + ["lone", "w1"]
    texts = [("u", "w1 x1 lone"), ("u", "w1 x1 lone"), ("u", "w2 x2"), ("v", "w2 x2, w70 x70")]
    rows = spark.createDataFrame([(1, u, t, "") for u, t in texts], "board_id long, url string, title string, description string")
    keywords = spark.createDataFrame([(1, k) for k in phrases], "board_id long, keyword string")
    found = [
        sorted(tuple(r) for r in M.keyword_hits(rows, keywords, strategy=s, small=b).collect())
        for s, b in (("scan", True), ("token", True), ("token", False))
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 9
