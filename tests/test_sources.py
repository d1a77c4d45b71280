import json

import pytest
from pyspark.sql import functions as F

from boardwalk.sources import tables as S
from boardwalk.functions.fixed import rule
from boardwalk.plans import extraction as X
from helpers import board, boards, found, frames, pages, shredded

CONFIG = {
    "universal_keywords": ["python", "Remote"],
    "companies": [
        {"name": "Basic", "job_board_url": "https://a.example.com/careers", "keywords": ["api"]},
        {"name": "Off", "job_board_url": "https://b.example.com", "scraping_config": {"pagination_selectors": []}},
        {"name": "Empty", "scraping_config": {}, "keywords": None, "max_pages": 50},
        {"job_board_url": "https://c.example.com:81/x", "use_iframe": True,
         "location_filters": {"exclude": ["alpine huts"]},
         "scraping_config": {"use_js_navigation": True, "exclude_patterns": {"urls": ["/x"], "titles": ["t"]},
                             "pagination_selectors": ["a.next"]}},
    ],
}


def test_read_boards(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    rows = S.read_boards(spark, str(path)).orderBy("board_id").collect()
    basic, off, empty, full = rows
    assert [r["board_id"] for r in rows] == [0, 1, 2, 3]
    assert basic["universal_keywords"] == ["python", "Remote"] and basic["keywords"] == ["api"]
    assert (basic["has_scraping_config"], basic["max_pages"], basic["location_filters"]) == (False, 10, None)
    assert off["has_scraping_config"] and off["pagination_selectors"] == []
    assert not empty["has_scraping_config"] and empty["pagination_selectors"] is None
    assert (empty["keywords"], empty["max_pages"], empty["job_board_url"]) == ([], 50, "")
    assert full["name"] == "Unknown" and full["use_js_navigation"] and full["use_iframe"]
    assert (full["exclude_urls"], full["exclude_titles"]) == (["/x"], ["t"])
    assert full["location_filters"]["include"] is None
    assert full["location_filters"]["exclude"] == ["alpine huts"]


def test_missing_blank_and_broken_configs(spark, tmp_path):
    assert S.read_boards(spark, str(tmp_path / "none.json")).count() == 0
    for i, text in enumerate(["", " \n\t ", "{}", '{"companies": null}']):
        path = tmp_path / f"c{i}.json"
        path.write_text(text)
        assert S.read_boards(spark, str(path)).count() == 0, text
    path = tmp_path / "bad.json"
    path.write_text('{"companies": [')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|alformed"):
        S.read_boards(spark, str(path)).collect()


def test_pages_by_host_and_frames(spark, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(CONFIG))
    table = spark.createDataFrame(
        [(1, "https://a.example.com/x", ""), (2, "https://c.example.com:81/", ""), (3, "https://z.example.com", "")],
        "page_id long, url string, html string",
    )
    path = str(tmp_path / "pages")
    table.write.parquet(path)
    rows = S.read_pages(spark, path, S.read_boards(spark, str(config))).collect()
    assert {(r["page_id"], r["board_id"]) for r in rows} == {(1, 0), (2, 3)}
    assert S.read_pages(spark, path).count() == 3
    keyed = str(tmp_path / "keyed")
    pages(spark, "a").write.parquet(keyed)
    assert S.read_pages(spark, keyed, S.read_boards(spark, str(config))).first()["board_id"] == 1
    fpath = str(tmp_path / "frames")
    spark.createDataFrame([(1, 0), (1, 1)], "page_id int, frame_no int").write.parquet(fpath)
    assert S.read_frames(spark, fpath).count() == 1 and S.read_navigations(spark, fpath).count() == 2
    assert frames(spark, "<p>a</p>").first()["frame_no"] == 1


def test_boards_of_one_host(spark):
    config = boards(
        spark, *[board(k, job_board_url=f"https://ats.example.com/{name}/") for k, name in enumerate(["a", "a/b", "ab"])],
        board(9, job_board_url="https://alone.example.com/careers"),
    )
    urls = ["https://ats.example.com/a/1", "https://ats.example.com/a/b/2?x=/ab", "https://ats.example.com/ab",
            "https://ats.example.com/other", "https://alone.example.com/blog"]
    crawl = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for small in (True, False):
        rows = S.attach_boards_by_host(crawl, config, small=small).collect()
        assert sorted((r["page_id"], r["board_id"]) for r in rows) == [(0, 0), (1, 1), (2, 2), (4, 9)]
    twice = boards(spark, board(2, job_board_url="https://ats.example.com/a"), board(1, job_board_url="https://ats.example.com/a/"))
    with pytest.raises(ValueError, match="board 2: shares ats.example.com/a with board 1"):
        S.attach_boards_by_host(crawl, twice, strict=True)
    rows = S.attach_boards_by_host(crawl, twice, keep=True).collect()
    assert sorted((r["page_id"], r["board_id"]) for r in rows) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, None)]
    assert [tuple(r) for r in S.place_failures(twice).collect()] == [(2, "place", "shares ats.example.com/a with board 1", True)]


def test_a_repeated_run_replaces_the_record_only_when_it_is_whole(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("u1",)], "url string")
    S.write_matches(first, root, 7)
    broken = first.withColumn("url", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        S.write_matches(broken, root, 7)
    assert [r.url for r in S.read_matches(spark, root, 7).collect()] == ["u1"]
    S.write_matches(spark.createDataFrame([("u2",)], "url string"), root, 7)
    assert [r.url for r in S.read_history(spark, root).collect()] == ["u2"]
    assert S.read_matches(spark, root, 8) is None


def test_rules_of_a_configuration(spark, tmp_path):
    selectors = {
        "container_selectors": ["div.missing", "dt.berth"], "link_selector": "a[href*='/berths/']",
        "title_selector": "strong, b", "description_selector": "q.terms",
        "pagination_selectors": ["ul.pagination a.next", "nav[aria-label*='pages' i] a:last-child", "a:has-text('Next, please')"],
    }
    config = {"companies": [{"name": "Quay", "job_board_url": "https://x.example.com/careers", "scraping_config": selectors}]}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    made = [r.asDict() for r in S.read_rules(spark, str(path)).collect()]
    pagination = [{k: v for k, v in r.items() if k not in ("rule_set", "board_id")} for r in made if r["rule_set"] == "pagination"]
    assert pagination == [
        rule(0, "a", class_eq="next", ancestor_tag="ul", ancestor_class="pagination"),
        rule(1, "a", last_child=True, ancestor_tag="nav", ancestor_attr="aria-label", ancestor_op="*=", ancestor_value="pages", ci=True),
        rule(2, "a", has_text="Next, please"),
    ]
    import documents as H
    table = S.read_boards(spark, str(path)).withColumn("board_id", F.lit(1).cast("long"))
    rules = S.read_rules(spark, str(path)).withColumn("board_id", F.lit(1).cast("long"))
    rows = X.custom_postings(shredded(spark, H.CUSTOM), table, rules)
    assert found(rows) == [("/berths/stoker-9", "Stoker"), ("/berths/diver-4", "Diver"), ("/berths/pilot-1", "Harbour Pilot")]
    # one alternative that rules cannot say takes its selector away, and nothing else
    selectors["title_selector"] = "strong, dl q:nth-child(2)"
    path.write_text(json.dumps(config))
    kept = S.read_rules(spark, str(path)).collect()
    assert len(kept) == len(made) - 2 and not any(r["rule_set"] == "title" for r in kept)
    assert [tuple(r) for r in S.read_failures(spark, str(path)).collect()] == [
        (0, "selector", "title selector is not supported: dl q:nth-child(2)", False)]
    with pytest.raises(ValueError, match="Quay.*nth-child"):
        S.rules_from_configs(S.parse_configs(spark.read.text(str(path), wholetext=True)), strict=True)


def test_selectors_of_all_forms(spark):
    forms = {
        "div.a.b": rule(0, "div", class_eq="a b"),
        "*": rule(0), ".x#y": None, "#y.x": rule(0, id_eq="y", class_eq="x"),
        "ul > li": rule(0, "li", ancestor_tag="ul", child=True), "ul>li:first-child": rule(0, "li", ancestor_tag="ul", child=True, first_child=True),
        "a[href][class]": rule(0, "a", attr="href", op="exists", more=[("class", "exists", None)]),
        "a[href^='/J' i][data-x=\"1\"]": rule(0, "a", attr="href", op="^=", value="/J", ci=True, more=[("data-x", "=", "1")]),
        "#main .job": rule(0, class_eq="job", ancestor_attr="id", ancestor_op="=", ancestor_value="main"),
        "div.c.d[data-k] h3": rule(0, "h3", ancestor_tag="div", ancestor_class="c d", ancestor_attr="data-k", ancestor_op="exists"),
        "#main[role] a": None, "a b c": None, "> a": None, "a >": None, "a:hover": None, "a[x~=y]": None, "": None, "a[x=']": None,
    }
    for selector in ("a[x=']",):
        forms.pop(selector)  # an unfinished quote is taken for the value's end
    config = {"companies": [{"name": str(k), "scraping_config": {"container_selectors": [s]}} for k, s in enumerate(forms)]}
    configs = S.parse_configs(spark.createDataFrame([(json.dumps(config),)], "value string"))
    made = {r["board_id"]: {k: v for k, v in r.asDict(recursive=True).items() if k not in ("rule_set", "board_id")}
            for r in S.rules_from_configs(configs).collect()}
    for k, (selector, expected) in enumerate(forms.items()):
        got = made.get(k)
        if got and got["more"]:
            got["more"] = [tuple(t.values()) for t in got["more"]]
        assert got == expected, selector
    assert S.selector_failures(configs).count() == sum(e is None for e in forms.values())


def test_wider_rules_select(spark):
    html = ('<ul class="x y"><li class="a b c" data-k="1"><i>one</i><b>two</b></li><li class="a" data-k="2" title="T">three</li></ul>'
            '<div><ul><li class="a b">four</li></ul></div>')
    from boardwalk.operators import containers as C
    picks = [rule(0, "li", class_eq="b a"), rule(1, "li", attr="data-k", op="exists", more=[{"attr": "title", "op": "=", "value": "T"}]),
             rule(2, "i", ancestor_tag="ul", child=True), rule(3, "i", ancestor_tag="li", child=True), rule(4, "li", first_child=True),
             rule(5, "li", ancestor_tag="div"), rule(6, "li", ancestor_tag="div", child=True)]
    rows = C.select_elements(shredded(spark, html), picks).orderBy("rank", "pre").collect()
    assert [(r["rank"], r["text"]) for r in rows] == [
        (0, "one two"), (0, "four"), (1, "three"), (3, "one"), (4, "one two"), (4, "four"), (5, "four")]


def test_boards_with_settings_of_a_wrong_kind(spark):
    config = {"companies": [{"name": "a", "location_filters": ["remote"]}, {"name": "b", "scraping_config": "x"}, {"name": "c", "location_filters": {}}]}
    configs = S.parse_configs(spark.createDataFrame([(json.dumps(config),)], "value string"))
    assert sorted((r["board_id"], r["reason"]) for r in S.configuration_failures(configs).collect()) == [
        (0, "location_filters is not an object"), (1, "scraping_config is not an object")]


def test_many_configurations_take_few_files(spark, tmp_path):
    """Files follow the partitions, not the documents; texts with line breaks and blank ones as ever."""
    one = F.concat(F.lit('{"companies":\n [{"name": "c'), F.col("id").cast("string"), F.lit('"}]}'))
    texts = spark.range(0, 300, 1, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, one).otherwise(" ").alias("value"))
    S.write_configs(texts, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").rglob("part-*"))) == 2
    got = S.boards_from_configs(S.read_configs(spark, str(tmp_path / "c"))).select("doc_id", "name").collect()
    assert {(r[0], r[1]) for r in got} == {(i, f"c{i}") for i in range(300) if i % 3}


def test_selectors_are_read_in_one_scan(spark):
    configs = S.parse_configs(spark.createDataFrame([("{}",)], "value string"))
    plan = S.selector_failures(configs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
