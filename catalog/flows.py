"""Configuration, pagination, history, report and the full run: S1, S6, G1-G2, H1-H2, R1-R3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.operators import history as H
from boardwalk.operators import paging as G
from boardwalk.operators import report as R
from boardwalk.plans.run import Run, run_boards, stage_shredded
from boardwalk.sources import tables as S
from catalog import derived as D
from catalog.registry import registry

QUERIES, ORACLE, query = registry()


@query("""
SELECT s_suppkey // 20 AS doc_id, s_suppkey % 20 AS board_id,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown' ELSE s_name END AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://s.example.com/' || s_suppkey END AS job_board_url,
       CASE WHEN s_suppkey % 5 = 0 THEN 30 ELSE 10 END AS max_pages,
       s_suppkey % 6 IN (1, 2) AS has_scraping_config, s_suppkey % 6 = 2 AS use_js_navigation,
       CASE WHEN s_suppkey % 6 = 1 THEN 0 ELSE -1 END AS n_pagination,
       CASE WHEN s_suppkey % 2 = 0 THEN 'remote' END AS first_include, 2 AS n_universal
FROM supplier""")
def s1_read_boards(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    scraping = (
        F.when(s % 6 == 0, F.lit("{}")).when(s % 6 == 1, F.lit('{"pagination_selectors": []}'))
        .when(s % 6 == 2, F.lit('{"use_js_navigation": true}')).when(s % 6 == 3, F.lit("null"))
    )

    def field(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), value))

    company = F.concat(F.lit("{"), F.concat_ws(
        ", ",
        field("name", F.when(s % 4 != 0, F.concat(F.lit('"'), "s_name", F.lit('"')))),
        field("job_board_url", F.when(s % 3 != 0, D.fill('"https://s.example.com/{s}"', s=s))),
        field("max_pages", F.when(s % 5 == 0, F.lit("30"))),
        field("location_filters", F.when(s % 2 == 0, F.lit('{"include": ["remote"]}'))),
        field("scraping_config", scraping),
    ), F.lit("}"))
    companies = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s_suppkey", company.alias("c")))), lambda x: x["c"]
    ), ", ")
    docs = D.table(spark, sf, "supplier").groupBy((s / 20).cast("long").alias("doc_id")).agg(
        F.concat(F.lit('{"universal_keywords": ["a", "b"], "companies": ['), companies, F.lit("]}"))
        .alias("value")
    )
    folder = D.scratch_folder(spark)
    docs.write.partitionBy("doc_id").text(folder)  # a file for each document
    return S.read_boards(spark, folder).select(
        F.col("doc_id").cast("long").alias("doc_id"), "board_id", "name", "job_board_url", "max_pages", "has_scraping_config",
        "use_js_navigation",
        F.coalesce(F.size("pagination_selectors"), F.lit(-1)).alias("n_pagination"),
        F.get(F.col("location_filters.include"), F.lit(0)).alias("first_include"),
        F.size("universal_keywords").alias("n_universal"),
    )


_OLD = "o_orderdate < TIMESTAMP '1998-06-01'"


def _order_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs: customers who ordered early are the history of those who order later."""
    orders = D.table(spark, sf, "orders").select(
        "o_orderdate", "o_orderkey", "o_orderpriority",
        D.fill("https://c.example.com/{c}", c=F.col("o_custkey")).alias("url"),
    )
    old = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")
    later = orders.filter(~old).select(
        "url", F.col("o_orderkey").alias("board_id"), F.col("o_orderpriority").alias("company")
    )
    return orders.filter(old).select("url"), later


_RUNS = f"""
runs AS (SELECT 'https://c.example.com/' || o_custkey AS url, o_orderkey AS board_id,
                o_orderpriority AS company, {_OLD} AS old FROM orders),
known AS (SELECT DISTINCT url FROM runs WHERE old)"""


@query(f"WITH {_RUNS} SELECT url, board_id, company FROM runs WHERE NOT old AND url NOT IN (SELECT url FROM known)")
def h1_new_matches(spark: SparkSession, sf: str) -> DataFrame:
    history, later = _order_runs(spark, sf)
    return H.new_matches(later, history)


@query(f"WITH {_RUNS} SELECT url, board_id, company FROM runs WHERE NOT old AND url IN (SELECT url FROM known)")
def h2_seen_matches(spark: SparkSession, sf: str) -> DataFrame:
    history, later = _order_runs(spark, sf)
    return H.seen_matches(later, history)


@query(f"""
WITH {_RUNS} SELECT url, board_id, company,
  CASE WHEN url IN (SELECT url FROM known) THEN 'seen' ELSE 'new' END AS section FROM runs WHERE NOT old""")
def h2_sections_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken when the history is too large to broadcast."""
    history, later = _order_runs(spark, sf)
    return H.with_section(later, history, small=False)


@query(f"WITH {_RUNS} SELECT url, board_id, company FROM runs WHERE NOT old AND url NOT IN (SELECT url FROM known)")
def h1_new_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """New matches against a history in buckets, which stays where it is."""
    history, later = _order_runs(spark, sf)
    folder = D.scratch_folder(spark)
    S.write_matches(history, folder, 1, buckets=8)
    return H.new_matches(later, S.read_history(spark, folder), small=False)


@query(f"WITH {_RUNS} SELECT url, board_id, company FROM runs WHERE NOT old AND url IN (SELECT url FROM known)")
def h2_seen_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """Seen matches against a history of any size, without buckets."""
    history, later = _order_runs(spark, sf)
    return H.seen_matches(later, history, small=False)


@query("SELECT DISTINCT 'https://c.example.com/' || o_custkey AS url FROM orders WHERE NOT (" + _OLD + ")")
def s6_write_history(spark: SparkSession, sf: str) -> DataFrame:
    history, later = _order_runs(spark, sf)
    folder = D.scratch_folder(spark)
    S.write_matches(history, folder, 1)
    S.write_matches(later, folder, 2)
    return S.read_history(spark, folder)


@query(f"""
WITH {D.PARTS_SQL}
SELECT DISTINCT board_id, page_id, origin || '/careers?page=' || (no + 1) AS next_url FROM parts WHERE no < 4""")
def g1_next_page_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = G.next_page_edges(D.part_shredded(spark, sf))
    return edges.select("board_id", "page_id", "next_url")


@query(f"""
WITH {D.PARTS_SQL}{D.BOARDS_SQL}
SELECT DISTINCT board_id, page_id, no AS page_no FROM parts JOIN boards USING (board_id) WHERE no <= max_pages""")
def g2_page_chain(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.part_pages(spark, sf).select("page_id", "board_id", "url")
    edges = G.next_page_edges(D.part_shredded(spark, sf))
    return G.page_chain(D.part_boards(spark, sf), pages, edges)


def _customer_matches(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return D.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("company"), F.col("c_name").alias("title"),
        D.fill("https://c.example.com/{c}", c=c).alias("url"),
        F.when(c % 3 == 0, "new").otherwise("seen").alias("section"),
        F.col("c_nationkey").cast("long").alias("board_id"),
        (c % 10).alias("page_no"), c.alias("seq"),
        F.when(c % 2 == 0, F.array(F.lit("api"), F.lit("go"))).otherwise(F.array(F.lit("qa")))
        .alias("matched_keywords"),
    )


_SECTION = "CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'seen' END"


@query(f"SELECT {_SECTION} AS section, c_mktsegment AS company, count(*) AS n_jobs FROM customer GROUP BY 1, 2")
def r1_report_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_groups(_customer_matches(spark, sf))


@query("SELECT c_mktsegment AS company, count(*) AS n_jobs FROM customer GROUP BY 1")
def r1_report_groups_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_groups(_customer_matches(spark, sf), by_section=False)


@query(f"""
SELECT count(*) AS total, count(*) FILTER ({_SECTION} = 'new') AS "new",
       count(*) FILTER ({_SECTION} = 'seen') AS seen, count(DISTINCT c_mktsegment) AS companies FROM customer""")
def r2_report_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_totals(_customer_matches(spark, sf))


@query(f"""
SELECT {_SECTION} AS section, c_mktsegment AS company, c_name AS title,
       'https://c.example.com/' || c_custkey AS url,
       CASE WHEN c_custkey % 2 = 0 THEN 'api, go' ELSE 'qa' END AS keywords FROM customer""")
def r3_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_rows(_customer_matches(spark, sf))


# --- full run over the part boards ------------------------------------------------------------

_CUSTOM = """
custom AS (
  SELECT page_id, board_id, no, k, kind, url, b, t, n,
         CASE kind WHEN 0 THEN n WHEN 1 THEN n || ' ' || t ELSE 'Newsletter ' || n END AS title,
         CASE kind WHEN 0 THEN b ELSE box_text END AS description
  FROM cards WHERE kind IN (0, 1, 7)
), custom_kept AS (
  SELECT * FROM custom WHERE NOT contains(url, '/jobs/1') AND NOT contains(lower(title), 'hot')
)"""


def _keyword_sql(word: str, condition: str) -> str:
    return f"CASE WHEN {condition} AND {D.edge_sql('body', repr(word))} THEN '{word}' END"


_RUN_SQL = f"""
WITH {D.POSTINGS_SQL}{D.BOARDS_SQL}, {_CUSTOM},
routed AS (
  SELECT p.* FROM postings p JOIN boards USING (board_id) WHERE NOT has_config AND no <= max_pages
  UNION ALL
  SELECT p.* FROM custom_kept p JOIN boards USING (board_id) WHERE has_config AND no <= max_pages
), texts AS (
  SELECT *, lower(title || ' ' || description) AS body FROM routed
), flagged AS (
  SELECT *, CASE WHEN board_id % 4 = 1 THEN contains(body, 'brand#1')
                 WHEN board_id % 4 = 2 THEN NOT (contains(body, 'small') OR contains(body, 'brand#2'))
                 ELSE false END AS dropped,
         concat_ws(', ', {_keyword_sql('gizmo', 'board_id % 3 = 1')}, {_keyword_sql('promo', 'board_id % 3 = 1')},
                   {_keyword_sql('red', 'true')}, {_keyword_sql('small', 'true')},
                   {_keyword_sql('widget', 'board_id % 3 = 0')}) AS keywords
  FROM texts
)"""


def full_run(spark: SparkSession, sf: str) -> Run:
    history = D.table(spark, sf, "part").filter("p_partkey % 3 = 0").select(
        D.fill("https://b{b}.example.com/jobs/{k}", b=(F.col("p_partkey") / 100).cast("long"),
               k=F.col("p_partkey")).alias("url")
    )
    boards = D.part_boards(spark, sf)
    shredded = stage_shredded(D.part_pages(spark, sf), boards, D.scratch_folder(spark))
    return run_boards(
        shredded, boards, D.custom_rules(spark), D.universal(), history=history
    )


@query(_RUN_SQL + """
SELECT CASE WHEN kind IN (0, 2, 6, 7) AND k % 3 = 0 THEN 'seen' ELSE 'new' END AS section,
       'Board ' || board_id AS company, title, url, keywords
FROM flagged WHERE NOT dropped AND keywords <> ''""")
def full_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_rows(full_run(spark, sf).matches)


@query(_RUN_SQL + """
SELECT b.board_id, b.name, count(f.url) AS listings, count(f.url) FILTER (f.dropped) AS dropped,
       count(f.url) FILTER (NOT f.dropped AND f.keywords <> '') AS matched
FROM boards b LEFT JOIN flagged f USING (board_id) GROUP BY 1, 2""")
def full_run_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return full_run(spark, sf).funnel.select("board_id", "name", "listings", "dropped", "matched")
