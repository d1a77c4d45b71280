"""Long lists of literal patterns against plain substring tests."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardwalk.functions import runs
from boardwalk.operators import matching as M
from boardwalk.operators import substrings as S
from boardwalk.operators import titles as T
from boardwalk.operators.links import exclude_links
from helpers import board, boards

ROWS = "board_id long, id long, body string"


def _cases(seed, texts, patterns):
    draw = random.Random(seed)
    alphabet = "aab éß😀.*+?#/\n漢"
    rows = [(draw.randrange(3), k, "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))) for k in range(texts)]
    rows += [(0, 900, None), (1, 901, ""), (2, 902, "aaaa" * 2000), (0, 903, rows[0][2]), (0, 903, rows[0][2])]
    words = [(draw.randrange(3), "".join(draw.choice(alphabet) for _ in range(draw.choice([1, 2, 3, 4, 5, 8])))) for _ in range(patterns)]
    return rows, [*words, words[0], (1, ""), (2, None)]


@pytest.mark.parametrize("small", [True, False, None])
def test_hits_match_plain_substrings(spark, small):
    rows, words = _cases(1, 120, 150)
    texts = spark.createDataFrame(rows, ROWS)
    patterns = spark.createDataFrame(words, "board_id long, pattern string")
    expected = sorted((i, p) for b, i, t in rows for p in {w for c, w in words if c == b and w} if t and p in t)
    found = S.literal_hits(texts, F.col("body"), patterns, keys=["id"], by=["board_id"], small=small)
    assert sorted((r["id"], r["pattern"]) for r in found.collect()) == expected and len(expected) > 300
    everywhere = S.literal_hits(texts, F.col("body"), patterns.select("pattern"), keys=["id"], small=small)
    expected = sorted((i, p) for _, i, t in rows for p in {w for _, w in words if w} if t and p in t)
    assert sorted((r["id"], r["pattern"]) for r in everywhere.collect()) == expected


@pytest.mark.parametrize("small", [True, False])
def test_flags_with_and_without_empty_patterns(spark, small):
    rows, words = _cases(2, 100, 12)
    texts = spark.createDataFrame(rows, ROWS)
    patterns = spark.createDataFrame(words, "board_id long, pattern string")

    def plain(own):
        return sorted((i, t is not None and any(w is not None and w in t for w in own(b))) for b, i, t in rows)

    got = S.flag_literals(texts, F.col("body"), patterns, by=["board_id"], small=small)
    assert got.columns == ["board_id", "id", "body", "hit"]
    assert sorted((r["id"], r["hit"]) for r in got.collect()) == plain(lambda b: [w for c, w in words if c == b])
    filled = [w for _, w in words if w]
    got = S.flag_literals(texts, F.col("body"), patterns.filter("pattern <> ''"), small=small)
    assert sorted((r["id"], r["hit"]) for r in got.collect()) == plain(lambda b: filled)
    whole = S.flag_literals(texts, F.col("body"), patterns, small=small).filter("hit").count()
    assert whole == sum(t is not None for _, _, t in rows)
    assert S.flag_literals(texts, F.col("body"), patterns.limit(0), small=small).filter("hit").count() == 0
    assert S.flag_literals(texts.limit(0), F.col("body"), patterns, small=small).count() == 0


def test_tables_and_lists_of_patterns_agree(spark):
    urls = [(1, "https://a/jobs/1"), (1, "https://a/Blog/2"), (2, "https://a/blog/3"), (2, "https://a/x")]
    links = spark.createDataFrame(urls, "board_id long, url string")
    for words in (["/blog", "x$"], ["/x", "jobs/1"], []):
        table = spark.createDataFrame([(w,) for w in words], "pattern string")
        left = sorted(map(tuple, exclude_links(links, words).collect()))
        assert sorted(map(tuple, exclude_links(links, table).collect())) == left
    own = spark.createDataFrame([(1, "jobs"), (2, "")], "board_id long, pattern string")
    assert [r["url"] for r in exclude_links(links, own).collect()] == ["https://a/Blog/2"]
    titles = spark.createDataFrame([("Hot Cook",), ("Hotel",), ("Baker",)], "title string")
    for words in (["hot "], ["Hot"], ["hot", "ak"]):
        table = spark.createDataFrame([(w,) for w in words], "pattern string")
        assert sorted(T.exclude_titles(titles, table).collect()) == sorted(T.exclude_titles(titles, words).collect())


def test_location_index_matches_scan(spark):
    filters = [None, {}, {"include": ["REMOTE, us"]}, {"include": ["berlin"]}, {"include": ["berlin", "us"]}, {"include": [""]},
               {"include": []}, {"exclude": ["Remote"]}, {"exclude": ["", "berlin"]}, {"include": ["us"], "exclude": ["dev"]},
               {"include": ["us"], "exclude": []}, {"include": ["us", "dev"], "exclude": ["us"]}]
    rows = [board(i, location_filters=None if f is None else (f.get("include"), f.get("exclude"))) for i, f in enumerate(filters)]
    texts = [("Dev", "Remote, US"), ("Cook", "Berlin"), ("", ""), (None, None), ("Dev", "Remote, US")]
    jobs = spark.createDataFrame([(i, f"u{k}", t, d) for i in range(len(rows) + 1) for k, (t, d) in enumerate(texts)],
                                 "board_id long, url string, title string, description string")
    config = boards(spark, *rows)
    scanned = sorted((r["board_id"], r["url"], r["dropped"]) for r in M.flag_location(jobs, config).collect())
    for small in (True, False):
        flagged = M.flag_location(jobs, config, strategy="index", small=small).collect()
        assert sorted((r["board_id"], r["url"], r["dropped"]) for r in flagged) == scanned


def test_many_loose_keywords_match_the_scan(spark):
    words = ["+" * a + s for a in range(1, 30) for s in ("", " ", "/", "#")] + ["", "c", "+a", "x+ y"]
    bodies = ["a++b", "a+/x", "+++", "a" + "+" * 29 + "#c", "x+ y", "été++é", "c", ""]
    jobs = spark.createDataFrame([(1, str(k), t, "") for k, t in enumerate(bodies)],
                                 "board_id long, url string, title string, description string")
    keywords = spark.createDataFrame([(1, w) for w in words], "board_id long, keyword string")
    found = [sorted(map(tuple, M.keyword_hits(jobs, keywords, strategy=s, small=b).collect()))
             for s, b in (("scan", True), ("token", True), ("token", False))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 8


def test_candidates_do_not_grow_with_patterns_that_share_short_runs(spark):
    """Numbers of many digits share their runs of four; a text has two runs of eight digits and so two candidates at most."""
    n = F.lpad(F.col("id").cast("string"), 9, "0")
    patterns = spark.range(0, 4000, 2).select(F.concat(F.lit("customer#"), n).alias("pattern"))
    texts = spark.range(4000).select("id", F.concat(F.lit("order 12 customer#"), n).alias("body"))
    hits = S.literal_hits(texts, F.col("body"), patterns, keys=["id"], small=False)
    assert hits.count() == 2000
    sizes, count, runs, _ = S._measured(patterns)
    body = texts.select(F.col("body").alias("_text"))
    anchors = S._anchored(body, patterns, [], sizes, runs, False).select("_gram")
    held = S._held(body, S._run_set(anchors.select(F.array("_gram").alias("_grams")), count), sizes)
    candidates = held.select(F.explode("_grams").alias("_gram")).join(anchors, "_gram").count()
    assert 2000 <= candidates <= 2 * 4000


def test_what_was_not_measured_small_is_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "abcdefghij")], "id long, body string")
    patterns = spark.createDataFrame([("cdefghijk",), ("bcdefghi",)], "pattern string")
    hits = S.literal_hits(texts, F.col("body"), patterns, keys=["id"], small=False)
    assert "BroadcastExchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in hits.collect()] == [(1, "bcdefghi")]


def test_runs_are_found_across_blocks_by_either_kind_of_set():
    """Sets of few and of many bits, and texts longer than a block that stays in a core's cache."""
    assert runs.BLOCK * 8 <= 1 << 19
    bodies = ["ab" * 20_000 + "needle in" + "ba" * 30_000, "", "needle i", "x" * (runs.BLOCK - 3) + "needle in"]
    wanted = np.array([int.from_bytes(b"needle i", "little"), int.from_bytes(b"ne", "little")], np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(bodies)], ["_text"])
    for bits in (20, runs.SPREAD_BITS + 1):
        sets = next(runs.set_words(iter([pa.RecordBatch.from_arrays([pa.array([wanted.view(np.int64)])], ["_grams"])]), bits))
        words = np.zeros(1 << bits >> 6, np.uint64)
        words[sets.column(0).to_numpy()] = sets.column(1).to_numpy().view(np.uint64)
        found = next(runs.held_runs(iter([batch]), "_text", words, bits, [2, 8]))
        assert found.column(0).to_pylist() == [bodies[0], bodies[2], bodies[3]]
        assert all({*wanted.tolist()} <= {*own} for own in found.column(1).to_pylist())
