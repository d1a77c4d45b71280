"""Page chains in all their forms, lists of thousands of patterns, and boards with long lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.operators import links as U
from boardwalk.operators import matching as M
from boardwalk.operators import paging as G
from boardwalk.operators import titles as T
from boardwalk.operators.shredding import shred, spread
from boardwalk.plans import extraction as X
from boardwalk.plans.run import run_boards, stage_shredded
from boardwalk.schemas import LOCATION
from boardwalk.session import stored
from catalog import derived as D
from catalog import postings
from catalog.registry import registry

QUERIES, ORACLE, query = registry()

# --- chains over orders: 200 orders are the pages of a board, walked up to 150 pages ---------------
#
# Boards by number, modulo four: 0 runs straight on; 1 turns back from its 41st page to its 11th, a
# cycle; 2 misses every 60th page; 3 starts in the middle and skips every second page.

_LENGTH, _LIMIT = 200, 150


def _order_places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = D.table(spark, sf, "orders").select(
        k.alias("page_id"), F.floor(k / _LENGTH).cast("long").alias("board_id"), (k % _LENGTH).alias("no"))
    return pages.filter((F.col("board_id") % 4 != 2) | (F.col("no") % 60 != 59))


def _place_url(no: Column) -> Column:
    return D.fill("https://o{b}.example.com/list?at={n}", b=F.col("board_id"), n=no)


def _order_chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boards, pages and edges."""
    kind, no = F.col("board_id") % 4, F.col("no")
    places = _order_places(spark, sf)
    following = F.when((kind == 1) & (no == 40), 10).when(kind == 3, no + 2).otherwise(no + 1)
    pages = places.select("page_id", "board_id", _place_url(no).alias("url"))
    edges = places.select("board_id", "page_id", _place_url(no).alias("url"), _place_url(following).alias("next_url"))
    start = F.when(kind == 3, 100).otherwise(0)
    boards = places.select("board_id").distinct().select(
        "board_id", _place_url(start).alias("job_board_url"), D.fill("Board {b}", b=F.col("board_id")).alias("name"),
        F.when(F.col("board_id") % 8 == 4, F.lit(None)).otherwise(_LIMIT).cast("int").alias("max_pages"))
    return boards, pages, edges


_WALK_SQL = f"""
WITH RECURSIVE places AS (
  SELECT o_orderkey AS page_id, o_orderkey // {_LENGTH} AS board_id, o_orderkey % {_LENGTH} AS no FROM orders
  WHERE (o_orderkey // {_LENGTH}) % 4 <> 2 OR o_orderkey % {_LENGTH} % 60 <> 59
), boards AS (
  SELECT DISTINCT board_id, CASE WHEN board_id % 4 = 3 THEN 100 ELSE 0 END AS start,
         CASE WHEN board_id % 8 = 4 THEN 10 ELSE {_LIMIT} END AS max_pages FROM places
), walk AS (
  SELECT p.board_id, p.page_id, p.no, 1 AS page_no, max_pages
  FROM boards b JOIN places p ON b.board_id = p.board_id AND p.no = b.start
  UNION ALL
  SELECT p.board_id, p.page_id, p.no, w.page_no + 1, w.max_pages FROM walk w JOIN places p ON p.board_id = w.board_id
    AND p.no = CASE WHEN w.board_id % 4 = 1 AND w.no = 40 THEN 10 WHEN w.board_id % 4 = 3 THEN w.no + 2 ELSE w.no + 1 END
  WHERE w.page_no < w.max_pages
)"""


@query(_WALK_SQL + " SELECT board_id, page_id, page_no FROM walk")
def g2_long_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of 150 pages, with cycles, gaps and starts in the middle."""
    return G.page_chain(*_order_chain(spark, sf))


@query(_WALK_SQL + """
SELECT page_id, board_id, CASE WHEN board_id % 4 = 2 THEN 'board not listed' ELSE 'no chain' END AS unreached
FROM places WHERE board_id % 4 = 2 OR page_id NOT IN (SELECT page_id FROM walk)
UNION ALL SELECT c_custkey + 100000000, -1, 'no board' FROM customer""")
def g2_unreached_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages beyond a limit, in a gap, on boards out of the run and of no board at all."""
    boards, pages, edges = _order_chain(spark, sf)
    listed = boards.filter("board_id % 4 <> 2")
    stray = D.table(spark, sf, "customer").select(
        (F.col("c_custkey") + 100_000_000).alias("page_id"), F.lit(None).cast("long").alias("board_id"),
        F.lit("https://nowhere.example.com/").alias("url"))
    left = G.unreached_pages(listed, pages.unionByName(stray), G.page_chain(listed, pages, edges))
    return left.withColumn("board_id", F.coalesce("board_id", F.lit(-1).cast("long")))


@query(_WALK_SQL + """, visits AS (SELECT DISTINCT board_id, page_id FROM walk)
SELECT b.board_id, 'Board ' || b.board_id AS name, count(v.page_id) * 2 AS listings, CAST(0 AS BIGINT) AS dropped,
       count(v.page_id) AS matched, count(p.page_id) AS pages, count(p.page_id) - count(v.page_id) AS unreached
FROM boards b JOIN places p USING (board_id) LEFT JOIN visits v USING (board_id, page_id) GROUP BY 1, 2""")
def m5_funnel_unreached(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel with crawled and unreached pages: two postings a page that is reached, one matches."""
    boards, pages, edges = _order_chain(spark, sf)
    account = G.page_account(boards, pages, G.page_chain(boards, pages, edges))
    found = pages.select("board_id", "page_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("matched"))
    flagged = G.number_pages(found, account).withColumn("dropped", F.lit(False))
    return M.board_funnel(boards, flagged, account)


_TWICE_SQL = f"""
WITH {D.PARTS_SQL}{D.BOARDS_SQL}, pages AS (SELECT DISTINCT page_id, board_id, no FROM parts),
snapshots AS (SELECT page_id, board_id, no FROM pages UNION ALL SELECT page_id + 1000000, board_id, no FROM pages WHERE no <> 2)
SELECT board_id, page_id, no AS page_no FROM snapshots JOIN boards USING (board_id) WHERE no <= max_pages"""


@query(_TWICE_SQL)
def g2_repeated_url(spark: SparkSession, sf: str) -> DataFrame:
    """Pages crawled twice under one URL take part in one visit; the earlier snapshot leads on."""
    pages = D.part_pages(spark, sf).select("page_id", "board_id", "url")
    again = pages.filter("page_id % 4 <> 1").withColumn("page_id", F.col("page_id") + 1_000_000)
    edges = G.next_page_edges(D.part_shredded(spark, sf))
    stray = edges.filter("page_id % 4 <> 1").select(
        "board_id", "url", (F.col("page_id") + 1_000_000).alias("page_id"), F.lit("https://else.example.com").alias("next_url"))
    return G.page_chain(D.part_boards(spark, sf), pages.unionByName(again), edges.unionByName(stray))


@query(f"""
WITH {D.PARTS_SQL}{D.BOARDS_SQL}
SELECT DISTINCT board_id, page_id, no AS page_no FROM parts JOIN boards USING (board_id) WHERE no <= max_pages""")
def g2_redirected_start(spark: SparkSession, sf: str) -> DataFrame:
    """The board's URL and the links lead to old addresses that the crawler was sent on from."""
    pages = D.part_pages(spark, sf).select("page_id", "board_id", "url")
    old = F.regexp_replace("url", "/careers", "/old")
    moved = pages.select("page_id", "board_id", "url", F.when(F.col("page_id") % 4 < 3, old).alias("requested_url"))
    edges = G.next_page_edges(D.part_shredded(spark, sf)).withColumn(
        "next_url", F.when(F.col("page_id") % 4 < 2, F.regexp_replace("next_url", "/careers", "/old")).otherwise(F.col("next_url")))
    boards = D.part_boards(spark, sf).withColumn("job_board_url", F.regexp_replace("job_board_url", "/careers", "/old"))
    return G.page_chain(boards, moved, edges)


# pages whose way on is a button: part pages with the links taken out of the menu
def _button_pages(spark: SparkSession, sf: str, markup: str) -> DataFrame:
    pages = D.part_pages(spark, sf)
    return pages.withColumn("html", F.regexp_replace("html", r'<a href="/careers\?page=[0-9]+" aria-label="(Back|Next)">[^<]*</a>', markup))


@query(f"""
WITH {D.PARTS_SQL}
SELECT DISTINCT board_id, page_id, page_id + 1 AS next_page_id FROM parts WHERE no < 4
  AND page_id + 1 IN (SELECT page_id FROM parts) AND page_id % 4 <> 2""")
def g1_button_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Where buttons without an address led, from the crawler's log; a third of the clicks is missing."""
    shredded = shred(_button_pages(spark, sf, "<button>Next</button>"))
    pages = D.part_pages(spark, sf).select("page_id", "board_id", "url")
    ids = pages.select("page_id")
    moves = ids.filter("page_id % 4 < 2").select("page_id", (F.col("page_id") + 1).alias("next_page_id"))
    edges = G.with_moves(G.next_page_edges(shredded), pages, moves)
    targets = pages.select(F.col("page_id").alias("next_page_id"), F.col("url").alias("next_url"))
    return edges.join(targets, "next_url").select("board_id", "page_id", "next_page_id")


@query(f"""
WITH {D.PARTS_SQL}
SELECT DISTINCT board_id, page_id, CASE board_id % 4 WHEN 1 THEN 'https://b' || board_id || '.example.com/own/' || page_id
   ELSE 'https://b' || board_id || '.example.com/std/' || page_id END AS next_url
FROM parts WHERE no < 4 AND board_id % 4 <> 2""")
def g1_own_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Boards with rules of their own (1), with pagination off (2), and by the default rules (0, 3)."""
    links = D.fill('<a class="fwd" href="/own/{p}">more</a><a rel="next" href="/std/{p}">next</a>', p=F.col("page_id"))
    pages = D.part_pages(spark, sf).withColumn("html", F.regexp_replace(
        F.regexp_replace("html", r'<a href="/careers[^"]*" aria-label="Next">[^<]*</a>', F.lit("@@")), F.lit("@@"), links))
    b = F.col("board_id")
    own = F.when(b % 4 == 1, F.array(F.lit("a.fwd"))).when(b % 4 == 2, F.array().cast("array<string>"))
    boards = D.part_boards(spark, sf).withColumns({"has_scraping_config": b % 4 < 3, "pagination_selectors": own})
    rules = boards.filter(b % 4 == 1).select("board_id")
    edges = G.next_page_edges(shred(pages), boards, D.rules_for(rules, "pagination", "a", class_eq="fwd"))
    return edges.select("board_id", "page_id", "next_url")


# --- thousands of patterns ------------------------------------------------------------------------

_MANY = 10_000


def _numbers(spark: SparkSession) -> DataFrame:
    return spark.range(_MANY)


@query(f"""
WITH urls AS (SELECT o_orderkey AS id, 'https://x.example.com/jobs/' || (o_orderkey * 37 % 100003) || '/c' || o_custkey AS url FROM orders),
patterns AS (SELECT '/' || (i * 13 + 7) || '/' AS pattern FROM range({_MANY}) t(i) UNION ALL SELECT 'c' || i FROM range(90, 100) t(i))
SELECT id, url FROM urls u WHERE NOT EXISTS (SELECT 1 FROM patterns WHERE contains(u.url, pattern))""")
def u8_many_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """URLs without any of ten thousand literal patterns."""
    k = F.col("o_orderkey")
    links = D.table(spark, sf, "orders").select(
        k.alias("id"), D.fill("https://x.example.com/jobs/{a}/c{c}", a=k * 37 % 100003, c=F.col("o_custkey")).alias("url"))
    patterns = _numbers(spark).select(D.fill("/{n}/", n=F.col("id") * 13 + 7).alias("pattern")).unionByName(
        spark.range(90, 100).select(D.fill("c{n}", n=F.col("id")).alias("pattern")))
    return U.exclude_links(links, patterns)


@query(f"""
WITH words AS (SELECT lower(c_name) AS pattern FROM customer UNION ALL SELECT 'Never' UNION ALL SELECT 'order ' || i || ' ' FROM range({_MANY}) t(i))
SELECT o_orderkey AS id, title FROM (
  SELECT o_orderkey, 'Order ' || (o_orderkey * 7) || ' Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS title FROM orders) t
WHERE NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(t.title), pattern))""")
def t7_many_words(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without any of thousands of words, taken as they are against the lower-cased title."""
    title = F.concat(D.fill("Order {k} Customer#", k=F.col("o_orderkey") * 7), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    titles = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"))
    words = D.table(spark, sf, "customer").select(F.lower("c_name").alias("pattern")).unionByName(
        _numbers(spark).select(D.fill("order {n} ", n=F.col("id")).alias("pattern"))).unionByName(
        spark.range(1).select(F.lit("Never").alias("pattern")))
    return T.exclude_titles(titles, words)


_DOC_BOARD = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)"
# pieces of benchmark passages, which some documents hold, and patterns that none does
_CUTS_SQL = f"""
docs AS (SELECT doc_id, {_DOC_BOARD} AS board_id, coalesce(lang, '') || ' ' || coalesce(text, '') AS body FROM documents),
ids AS (SELECT DISTINCT board_id FROM docs),
cuts AS (SELECT DISTINCT board_id, substr(text, CAST(1 + i * 9 AS INT), 9) AS pattern
         FROM benchmark, range(20) t(i), ids WHERE length(text) > i * 9 AND item_id % 4 = board_id % 4
         UNION SELECT board_id, 'Nowhere ' || i FROM ids, range(500) t(i))"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    board = F.regexp_extract("source", "([0-9]+)$", 1).cast("long")
    return spread(D.table(spark, sf, "documents")).select(
        "doc_id", board.alias("board_id"), F.coalesce("lang", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("description"))


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    ids = _documents(spark, sf).select("board_id").distinct()
    at = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")
    items = D.table(spark, sf, "benchmark").select("text", (F.col("item_id") % 4).alias("q"), at)
    pieces = items.filter(F.length("text") > F.col("i") * 9).select(
        "q", F.substr("text", 1 + F.col("i") * 9, F.lit(9)).alias("pattern"))
    held = ids.withColumn("q", F.col("board_id") % 4).join(pieces, "q").select("board_id", "pattern")
    absent = ids.select("board_id", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("i")).select(
        "board_id", D.fill("Nowhere {n}", n=F.col("i")).alias("pattern"))
    return held.unionByName(absent).distinct()


@query(f"""
WITH {_CUTS_SQL}
SELECT doc_id, board_id FROM docs d WHERE CASE WHEN board_id % 3 = 0
  THEN EXISTS (SELECT 1 FROM cuts c WHERE c.board_id = d.board_id AND contains(lower(body), lower(pattern)) AND pattern <> '')
  WHEN board_id % 3 = 1
  THEN NOT EXISTS (SELECT 1 FROM cuts c WHERE c.board_id = d.board_id AND contains(lower(body), lower(pattern)) AND length(pattern) = 9
                   AND contains(pattern, 'e'))
  ELSE true END""")
def m2_many_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Location filters of hundreds of patterns a board, looked up by an index; board 0 modulo 3 includes,
    1 excludes, 2 has none."""
    p, b = F.col("pattern"), F.col("board_id")
    own = F.collect_list(F.when((b % 3 == 0) | ((F.length(p) == 9) & F.contains(p, F.lit("e"))), p))
    none = F.array().cast("array<string>")
    filters = F.when(b % 3 == 0, F.struct(F.col("own").alias("include"), none.alias("exclude"))).when(
        b % 3 == 1, F.struct(none.alias("include"), F.col("own").alias("exclude")))
    boards = _cuts(spark, sf).groupBy("board_id").agg(own.alias("own")).select("board_id", filters.cast(LOCATION).alias("location_filters"))
    kept = M.location_filter(_documents(spark, sf), boards, strategy="index")
    return kept.select("doc_id", "board_id")


@query("""
WITH bodies AS (SELECT o_orderkey AS id, o_custkey % 5 AS board_id, 'tag' || repeat('+', CAST(o_orderkey % 7 AS INT)) || ' x'
    || repeat('-', CAST(o_orderkey % 11 AS INT)) || '/' || repeat('*', CAST(o_orderkey % 13 AS INT)) || 'y' AS body FROM orders),
words AS (SELECT repeat('+', CAST(a AS INT)) || ' ' AS k FROM range(1, 7) t(a)
          UNION ALL SELECT repeat('-', CAST(a AS INT)) || '/' || repeat('*', CAST(b AS INT)) FROM range(0, 11) t(a), range(0, 13) u(b))
SELECT id, k AS keyword FROM bodies, words
WHERE board_id < 3 AND (contains(body, 'g' || k || 'x') OR contains(body, 'x' || k || 'y'))""")
def m3_loose_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords without a word in them, more than are tried one by one: an edge on either side."""
    k = F.col("o_orderkey")

    def times(char: str, n: Column) -> Column:
        return F.repeat(F.lit(char), n.cast("int"))

    body = F.concat(F.lit("tag"), times("+", k % 7), F.lit(" x"), times("-", k % 11), F.lit("/"), times("*", k % 13), F.lit("y"))
    postings = D.table(spark, sf, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 5).alias("board_id"), body.alias("title"), F.lit("").alias("description"))
    n = spark.range(13 * 11).select((F.col("id") % 11).alias("a"), F.floor(F.col("id") / 11).alias("b"))
    loose = n.select(F.concat(times("-", F.col("a")), F.lit("/"), times("*", F.col("b"))).alias("keyword")).unionByName(
        spark.range(1, 7).select(F.concat(times("+", F.col("id")), F.lit(" ")).alias("keyword"))).unionByName(
        spark.range(100).select(D.fill("#{a}#", a=F.col("id")).alias("keyword")))
    boards = spark.range(3).select(F.col("id").alias("board_id"))
    keywords = boards.crossJoin(loose).select("board_id", "keyword")
    return M.keyword_hits(postings, keywords, key=["board_id", "id"], strategy="token").select("id", "keyword")


# --- pages of boards whose rules are too many to broadcast, one board with half of them ----------------

@query(f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0 ELSE board_id END AS board_id, url, title, description
FROM ({postings.ORACLE["x4_custom_postings"]})""")
def x4_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """The way of large rule tables: pages shuffle once, and the board with half of them is split."""
    pages = D.part_shredded(spark, sf).withColumn("board_id", F.when(F.col("page_id") % 2 == 0, 0).otherwise(F.col("board_id")))
    found = X.custom_postings(stored(pages), D.part_boards(spark, sf), D.custom_rules(spark), small=False)
    return found.select(*postings._COLUMNS)


# --- a run whose boards have lists of all lengths -------------------------------------------------

_FAR_WORDS = 5_000


@query(f"""
WITH {D.POSTINGS_SQL}
SELECT board_id, count(*) AS listings, count(*) FILTER (board_id % 3 <> 2 AND
       {D.edge_sql("lower(title || ' ' || description)", "'red'")}) AS matched FROM postings GROUP BY 1""")
def m3_mixed_boards(spark: SparkSession, sf: str) -> DataFrame:
    """One run with boards of thousands of keywords (0 modulo 3), of one keyword (1) and of none (2)."""
    b = F.col("board_id")
    many = F.concat(F.transform(F.sequence(F.lit(1), F.lit(_FAR_WORDS)), lambda i: F.concat(F.lit("Zz"), i.cast("string"))),
                    F.array(F.lit("RED")))
    boards = D.part_boards(spark, sf).withColumns({
        "keywords": F.when(b % 3 == 0, many).when(b % 3 == 1, F.array(F.lit("Red"))).otherwise(F.array().cast("array<string>")),
        "location_filters": F.lit(None).cast(LOCATION), "has_scraping_config": F.lit(False)})
    shredded = stage_shredded(D.part_pages(spark, sf), boards, D.scratch_folder(spark))
    run = run_boards(shredded, boards, D.custom_rules(spark), follow_pages=False)
    return run.funnel.select("board_id", "listings", "matched")


@query(f"""
WITH {D.PARTS_SQL}{D.BOARDS_SQL}
SELECT 'reached' AS kind, count(DISTINCT page_id) AS n FROM parts JOIN boards USING (board_id) WHERE no <= max_pages
UNION ALL SELECT 'unreached', count(DISTINCT page_id) FROM parts JOIN boards USING (board_id) WHERE no > max_pages
UNION ALL SELECT 'pages', count(DISTINCT page_id) FROM parts""")
def g2_run_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What a run says of its pages: those in, those reached, those not; taken while they are stored."""
    boards = D.part_boards(spark, sf)
    shredded = stage_shredded(D.part_pages(spark, sf), boards, D.scratch_folder(spark))
    run = run_boards(shredded, boards, D.custom_rules(spark), D.universal())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).cast("long").alias("n")) for k, n in run.coverage.items()])
    return boards.limit(1).select(F.explode(kinds).alias("r")).select("r.*")
