"""HTML extraction, vectors and chats."""

import itertools
import math
import random
import time

import duckdb
import numpy as np
import pytest

from boardwalk.llm import chat_format, components, html_main, queries, vectors

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Please accept all of them before you read on.</p></div>
<main><h1>Title &amp; more</h1><div class="post-body"><p>First   paragraph, with <a href=x>a link</a> and
<b>bold text.</b></p><div class="ad">Buy now at our shop, which has very long advertising texts.</div><p>Short.</p>
<script>if (a<b) { x = "</p>" }</script><blockquote>Quoted &lt;words&gt;&nbsp;here</blockquote>
<form><label>Mail</label><input name=q><button>Send</button></form></div>
<section id="comments"><p>Great post, I really liked reading it a lot, thank you very much.</p></section></main>
<aside><p>Another story which is long enough to look like the content of the page itself.</p></aside>
<footer>&copy; Site</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_main.main_text(PAGE) == (
        "Title & more First paragraph, with a link and bold text. Short. Quoted <words> here")


def test_broken_and_empty_pages():
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<p></p>") == ""
    assert html_main.main_text("<article><p><b>One two three.<br><p>Four") == "One two three. Four"
    assert html_main.main_text("<article><p>a < b and c > d</p></article") .startswith("a < b and c > d")
    assert html_main.main_text("<article><p>kept</p><script>never closed <p>x") == "kept"
    assert html_main.main_text("</div></p><article>x" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "x deep"


@pytest.mark.parametrize("page", [
    "<a " * 300_000, "<!" * 400_000, "<div>" * 500 + "</b>" * 200_000, '<a ">" ' * 120_000, "<" + "a" * 800_000,
    "<i>" * 60_000 + "<p>x</p>" * 60_000, "<p title=it's>word</p>" * 40_000, "<a '" * 200_000 + ">",
    "<p " + "id='" * 200_000 + ">x</p>", "<!--" * 200_000, "&#" + "9" * 800_000 + ";",
], ids=["tags", "declarations", "ends", "quoted_ends", "name", "inline", "marks", "open_marks", "attributes", "comments", "number"])
def test_broken_pages_take_time_in_proportion(page):
    began = time.monotonic()
    html_main.main_text(page)
    # what grew with the square took minutes to hours at this length
    assert time.monotonic() - began < 20


def test_tags_without_an_end_are_text():
    assert html_main.main_text("<article><p>one <b c=\"d>two</b> three</p><p>four</p></article>") == (
        'one <b c="d>two three four')
    assert html_main.main_text("<article><p>one</p><p>two <b three") == "one two <b three"


def test_references_are_of_one_run_of_text():
    def text(inner):
        return html_main.main_text(f"<article><p>{inner}</p></article>")

    assert text("a &am<b>p;</b> b") == "a &amp; b"
    assert text("a &#" + "0" * 6000 + "65; &#x" + "0" * 20 + "42; b") == "a A B b"
    assert text("a &#" + "9" * 6000 + "; b") == "a \ufffd b"
    assert text("a &lt;b&gt; &nbsp; &copy b") == "a <b> \u00a9 b"


def test_doubtful_blocks_follow_their_surroundings():
    page = "<article><p>" + "long text. " * 20 + "</p><p>see <a href=x>a link</a></p><p>" + "more text. " * 20 + "</p></article>"
    assert "see a link" in html_main.main_text(page)
    menu = "<body>" + "<div><a href=x>link</a></div>" * 5 + "</body>"
    assert html_main.main_text(menu) == ""


def test_minimum_cut_matches_brute_force():
    draw = random.Random(2)
    for _ in range(150):
        n = draw.randrange(1, 9)
        gains = [draw.randrange(-12, 13) for _ in range(n)]
        edges = [(a, b, draw.randrange(0, 6)) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.4]

        def cost(side):
            return (sum(g for g, s in zip(gains, side) if g > 0 and not s) - sum(g for g, s in zip(gains, side) if g < 0 and s)
                    + sum(w for a, b, w in edges if side[a] != side[b]))

        assert cost(html_main.source_side(gains, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "v", ""), (2, "v", PAGE)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(str, map(tuple, html_main.extract(table).collect())))
    main = html_main.main_text(PAGE)
    assert got == sorted(map(str, [(1, "u", main, len(main)), (None, None, "", 0), (2, "v", "", 0), (2, "v", main, len(main))]))


def unit(draw, size=16):
    x = draw.normal(size=size)
    return x / np.linalg.norm(x)


def brute(rows):
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        x, y = np.array(x, float), np.array(y, float)
        if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[a].add(b)
            links[b].add(a)
    root = {}
    for i in sorted(ids):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = i
                stack += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER", 60)
    draw = np.random.default_rng(1)
    rows = [(k, unit(draw)) for k in range(250)]
    for group in range(6):
        center = unit(draw)
        rows += [(1000 + 100 * group + k, center + 0.15 * unit(draw) * k / 10) for k in range(12)]
    rows += [(3000 + k, rows[3][1]) for k in range(20)]
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    judged = vectors.near_duplicates(frame)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in judged.collect()}
    expected = brute(rows)
    assert all(got[i][0] <= expected[i][0] for i in expected)  # none below the limit
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(e[0] for e in expected.values())
    assert sum(got[i][1] == expected[i][1] for i in expected) >= 0.99 * len(expected)
    assert {r.recall >= 0.95 for r in judged.collect()} == {True}


def test_large_blocks_and_audit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    draw = np.random.default_rng(2)
    center = unit(draw)
    rows = [(k, (center + 0.2 * unit(draw)).tolist()) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    judged = vectors.near_duplicates(frame)
    expected = brute(rows)
    assert sum(r.n_links for r in judged.collect()) >= 0.98 * sum(e[0] for e in expected.values())
    assert {r.recall >= 0.95 for r in judged.collect()} == {True}


def test_audit_counts_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "AUDIT_BLOCK", 7)  # several blocks of queries
    draw = np.random.default_rng(3)
    center = unit(draw)
    rows = [(10 * k, (center + 0.3 * unit(draw)).tolist()) for k in range(120)] + [(7, [0.5] * 16), (2000, [0.5] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes, members = vectors._nodes(vectors.comparable(frame), 16)
    x = np.array([v for _, v in rows[:-1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in rows[:-1]]
    near = [(ids[a], ids[b]) for a, b in itertools.combinations(range(len(ids)), 2) if x[a] @ x[b] >= 0.9]
    # 2000 is a copy of 7, which stands for both and so is audited
    asked = {i for i in ids if i % 100 == 0} | {7}
    kept = near[::3] + [(b, a) for a, b in near[1::3]]  # either direction counts as found
    ends = lambda pairs: sum((a in asked) + (b in asked) for a, b in pairs)
    got = vectors.audit(nodes, members, spark.createDataFrame(kept, "id long, other long"))
    assert got == ends(kept) / ends(near) and 0 < got < 1


def test_low_recall_builds_the_graph_again(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER", 25)
    draw = np.random.default_rng(4)
    center = unit(draw)
    rows = [(100 * k, (center + 0.32 * unit(draw)).tolist()) for k in range(150)]  # one cloud that clusters cut
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes, members = vectors._nodes(vectors.comparable(frame), 16)
    once = vectors.links(nodes, 1)
    assert vectors.audit(nodes, members, once.selectExpr("id", "explode(found) AS other")) < vectors.TARGET
    judged = vectors.near_duplicates(frame, overlap=1).collect()
    truth = sum(e[0] for e in brute(rows).values())
    assert {r.recall for r in judged} == {sum(r.n_links for r in judged) / truth}  # all ids are audited
    assert judged[0].recall >= vectors.TARGET


def test_regions_in_parts_and_waves_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER", 40)
    monkeypatch.setattr(vectors, "REGION", (1, 2))
    monkeypatch.setattr(vectors, "LARGEST", 60)  # regions are dealt into parts that search each other
    monkeypatch.setattr(vectors, "WAVE_MB", 1e-4)
    draw = np.random.default_rng(5)
    centers = [unit(draw) for _ in range(4)]
    rows = [(k, (centers[k % 4] + 0.3 * unit(draw)).tolist()) for k in range(320)] + [(1000 + k, unit(draw).tolist()) for k in range(40)]
    rows += [(2000 + k, rows[5][1]) for k in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    expected = brute(rows)
    assert all(got[i][0] <= expected[i][0] for i in expected)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(e[0] for e in expected.values())
    assert sum(got[i][1] == expected[i][1] for i in expected) >= 0.99 * len(expected)


def test_searches_go_on_in_regions_of_near_nodes():
    """A link whose ends share no region is found by way of a node that is in both."""
    import pyarrow as pa

    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    region_of = np.array([0, 1], np.int32)
    left, middle, right = (1, turn(0), [0, 0]), (2, turn(12), [0, 1]), (3, turn(24), [1, 1])

    def rows(region, *nodes, role=vectors.BOTH, starts=None):
        return pa.RecordBatch.from_pylist([
            {"region": region, "part": 0, "asked": 0, "id": i, "vector": v, "clusters": c, "role": role, "starts": starts}
            for i, v, c in nodes], pa.schema([("region", pa.int32()), ("part", pa.int32()), ("asked", pa.int32()), ("id", pa.int64()),
                                              ("vector", pa.list_(pa.float64())), ("clusters", pa.list_(pa.int32())),
                                              ("role", pa.int32()), ("starts", pa.list_(pa.int64()))]))

    search = vectors._search(region_of)
    out = [r for b in search(iter([rows(0, left, middle)])) for r in b.to_pylist()]
    assert [(r["id"], r["found"], r["root"]) for r in out if r["region"] is None] == [(1, [2], 1), (2, [1], 1)]
    (ahead,) = [r for r in out if r["region"] is not None]
    assert (ahead["id"], ahead["region"], ahead["found"]) == (1, 1, [2])
    out = [r for b in search(iter([rows(1, middle, right, role=vectors.HELD), rows(1, left, role=vectors.ASKED, starts=[2])]))
           for r in b.to_pylist()]
    assert [(r["id"], r["found"], r["root"]) for r in out] == [(1, [2, 3], 1), (2, [1], 1), (3, [1], 1)]


def test_vectors_need_disk_in_proportion(spark, monkeypatch):
    """Stored tables and shuffle files at their most, for nodes whose neighbours lie in many blocks."""
    import pathlib
    import threading

    monkeypatch.setattr(vectors, "CLUSTER", 150)
    draw = np.random.default_rng(6)
    rows = [(k, [float(np.float32(v)) for v in unit(draw, 64)]) for k in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
    places = [pathlib.Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    places.append(pathlib.Path(spark.conf.get("spark.checkpoint.dir")))

    def used():
        total = 0
        for place in places:
            for path in place.rglob("*"):
                try:
                    total += path.stat().st_size * path.is_file()
                except OSError:  # gone meanwhile
                    pass
        return total

    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.2):
            most[0] = max(most[0], used() - before)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert vectors.near_duplicates(frame).count() == len(rows)
    finally:
        over.set()
        thread.join()
    # lists, copies of neighbours and searches that were moved took some 60 times the vectors
    assert 0 < most[0] <= 12 * 256 * len(rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [math.nan, 1.0]),
            (6, [math.inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]),
            (11, [1e300, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component_id int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()]
    assert len(got) == len(rows)
    expected = {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False), None: (0, None, True)}
    for name, *rest in got:
        assert tuple(rest) == expected.get(name, (0, name, True))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200), (300, 200), (None, 1)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 200: 200, 201: 200, 300: 200}


TURNS = "conv_id long, turn long, role string, text string"


def test_maximal_conversations(spark):
    a = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")]
    rows = [(1, *t) for t in a[:1]] + [(2, *t) for t in a[:2]] + [(3, *t) for t in a] + [(4, *t) for t in a]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "user", None), (7, 0, "user", ""), (7, 0, "user", "")]
    rows += [(None, 0, None, "x"), (8, None, "user", "first"), (8, 0, "user", "then")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], TURNS + ", n_turns int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.format_chats(frame).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert got[3] == (3, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>")
    assert got[6] == (1, 1, "<|user|>\n<|end|>") and got[7] == (1, 1, "<|user|>\n<|end|>")
    assert got[None][2] == "<|unknown|>\nx<|end|>"
    assert got[8][2] == "<|user|>\nfirst<|end|>\n<|user|>\nthen<|end|>"
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_chats_with_ties_and_nulls_equal_their_sql(spark):
    draw = random.Random(8)
    logs = {1: [(0, "a", "x"), (1, "b", "y")], 2: [(0, "a", "x"), (1, "b", "y"), (1, "c", "z")],
            3: [(0, "a", "x"), (1, "b", "y"), (2, "c", "z")], 4: [(1, "a", "x"), (2, "b", "y")]}
    for name in [None, *range(10, 200)]:
        base = [(draw.choice([None, 0, 0, 1, 1, 2, 3]), draw.choice([None, "", "a"]), draw.choice([None, "", "x"]))
                for _ in range(draw.randint(1, 4))]
        logs[name] = base
    frame = spark.createDataFrame([(i, *t) for i, turns in logs.items() for t in turns], TURNS)
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    expected = con.execute(queries._CHATS_SQL).fetchall()
    got = chat_format.format_chats(frame).select("conv_id", "n_turns", "n_copies", "text").collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got)
    # two turns with one number are one place: neither is a prefix without the other
    assert {2, 3} <= {r.conv_id for r in got} and not {1} & {r.conv_id for r in got}


def test_chats_need_no_python(spark, sf):
    plan = queries.op10_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns and len(got)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, expected[columns].values.tolist()))
