"""Containers, titles and extraction flows: C1-C6, T1-T7, X1-X7, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.functions.fixed import DEFAULT_EXCLUDED_TITLES
from boardwalk.operators import containers as C
from boardwalk.operators import titles as T
from boardwalk.operators.shredding import shred, spread
from boardwalk.plans import extraction as X
from boardwalk.plans.run import stage_frames, stage_shredded
from catalog import derived as D
from catalog.pages import navigation_log, part_frames
from catalog.registry import registry

QUERIES, ORACLE, query = registry()

_CODES = "SELECT page_id, CAST(code AS INT) AS code, box_text AS text FROM cards"


@query(f"WITH {D.CARD_SQL} {_CODES} WHERE kind IN (0, 1, 2, 7)")
def c1_keyword_containers(spark: SparkSession, sf: str) -> DataFrame:
    return C.keyword_containers(D.part_shredded(spark, sf)).select("page_id", "code", "text")


@query(f"WITH {D.CARD_SQL} {_CODES} WHERE kind = 5")
def c2_result_item_containers(spark: SparkSession, sf: str) -> DataFrame:
    return C.result_item_containers(D.part_shredded(spark, sf)).select("page_id", "code", "text")


@query(f"WITH {D.CARD_SQL} {_CODES} WHERE kind = 3 AND length(box_text) > 10")
def c3_row_containers(spark: SparkSession, sf: str) -> DataFrame:
    return C.row_containers(D.part_shredded(spark, sf)).select("page_id", "code", "text")


@query(f"""
WITH {D.CARD_SQL}, ranked AS (
  SELECT page_id, CASE WHEN kind IN (0, 1, 7) THEN 1 ELSE 2 END AS rank, box_text AS text
  FROM cards WHERE kind IN (0, 1, 2, 7)
), best AS (SELECT page_id, min(rank) AS rank FROM ranked GROUP BY 1)
SELECT page_id, rank, text FROM ranked JOIN best USING (page_id, rank)""")
def c4_first_matching_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = D.custom_rules(spark)
    return C.first_matching_rule(D.part_shredded(spark, sf), rules).select("page_id", "rank", "text")


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return shred(spread(part_frames(spark, sf)))


@query("""
SELECT p_partkey // 5 AS page_id, CAST(p_partkey % 5 AS INT) AS frame_no, 0 AS rank,
       p_name || ' ' || p_type || ' ' || p_brand AS text FROM part""")
def c5_frame_containers(spark: SparkSession, sf: str) -> DataFrame:
    return C.frame_containers(_frames(spark, sf)).select("page_id", "frame_no", "rank", "text")


@query("""
SELECT p_partkey // 5 AS page_id, CAST(p_partkey % 5 AS INT) AS frame_no FROM part
WHERE p_partkey % 3 <> 0""")
def c6_job_frames(spark: SparkSession, sf: str) -> DataFrame:
    return C.job_frames(_frames(spark, sf)).select("page_id", "frame_no")


_TITLES = """
SELECT page_id, CAST(code AS INT) AS code, url, box_title AS title FROM cards WHERE code IS NOT NULL
  AND NOT (kind = 3 AND length(box_text) <= 10)
UNION ALL
SELECT page_id, 115 + CASE kind WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 1 THEN 3 ELSE 1 END, url, link_text
FROM cards WHERE kind <> 5"""


@query(f"WITH {D.CARD_SQL} SELECT * FROM ({_TITLES}) WHERE code < 114")
def t1_default_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.container_titles(D.part_shredded(spark, sf)).filter(F.col("code") < C.ROW_CODE)
    return rows.select("page_id", "code", "url", "title")


@query(f"WITH {D.CARD_SQL} SELECT * FROM ({_TITLES}) WHERE code >= 114")
def t2_row_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.container_titles(D.part_shredded(spark, sf)).filter(F.col("code") >= C.ROW_CODE)
    return rows.select("page_id", "code", "url", "title")


_CUSTOM = """
SELECT page_id, board_id, url,
       CASE kind WHEN 0 THEN n WHEN 1 THEN n || ' ' || t ELSE 'Newsletter ' || n END AS title,
       CASE kind WHEN 0 THEN b ELSE box_text END AS description
FROM cards WHERE kind IN (0, 1, 7)"""
_CUSTOM_KEPT = f"""
SELECT * FROM ({_CUSTOM}) WHERE NOT contains(url, '/jobs/1') AND NOT contains(lower(title), 'hot')"""


@query(f"WITH {D.CARD_SQL} SELECT url, title FROM ({_CUSTOM_KEPT})")
def t3_custom_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _custom(spark, sf).select("url", "title")


@query(f"WITH {D.CARD_SQL} SELECT url, description FROM ({_CUSTOM_KEPT})")
def t4_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return _custom(spark, sf).select("url", "description")


def _document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document."""
    return D.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "title"))


_DOC_TITLES = """
titles AS (
  SELECT doc_id, CAST(unnest(range(len(lines))) AS INT) AS line, unnest(lines) AS title
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
)"""


@query(f"WITH {_DOC_TITLES} SELECT doc_id, line, title FROM titles WHERE length(title) >= 3")
def t5_valid_titles(spark: SparkSession, sf: str) -> DataFrame:
    return T.valid_titles(_document_titles(spark, sf))


@query(f"""
WITH {_DOC_TITLES}
SELECT doc_id, line, title FROM titles
WHERE len(list_filter(regexp_split_to_array(title, '[\\s\\x{{85}}\\x{{A0}}]+'), lambda w: w <> '')) >= 2""")
def t6_multiword_titles(spark: SparkSession, sf: str) -> DataFrame:
    return T.multiword_titles(_document_titles(spark, sf))


_BLOCKED = " OR ".join(f"contains(lower(text), '{w}')" for w in [*DEFAULT_EXCLUDED_TITLES, "the", "über"])


@query(f"SELECT doc_id FROM documents WHERE NOT ({_BLOCKED})")
def t7_exclude_titles(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))
    return T.exclude_titles(docs, [*DEFAULT_EXCLUDED_TITLES, "the", "über", "THE"]).select("doc_id")


_COLUMNS = ["page_id", "board_id", "url", "title", "description"]


@query(f"""
WITH {D.CARD_SQL}
SELECT page_id, board_id, url, box_title AS title, box_text AS description FROM cards
WHERE kind IN (0, 1, 2, 5) OR (kind = 3 AND length(box_text) > 10)""")
def x1_container_postings(spark: SparkSession, sf: str) -> DataFrame:
    return X.container_postings(D.part_shredded(spark, sf)).select(*_COLUMNS)


@query(f"""
WITH {D.CARD_SQL}
SELECT page_id, board_id, url, link_text AS title, around AS description FROM cards
WHERE kind NOT IN (2, 5)""")
def x2_direct_link_postings(spark: SparkSession, sf: str) -> DataFrame:
    return X.direct_link_postings(D.part_shredded(spark, sf)).select(*_COLUMNS)


@query(f"WITH {D.POSTINGS_SQL} SELECT page_id, board_id, url, title, description FROM postings")
def x3_default_postings(spark: SparkSession, sf: str) -> DataFrame:
    return X.default_postings(D.part_shredded(spark, sf)).select(*_COLUMNS)


def _custom(spark: SparkSession, sf: str) -> DataFrame:
    return X.custom_postings(
        D.part_shredded(spark, sf), D.part_boards(spark, sf), D.custom_rules(spark)
    )


@query(f"""
WITH {D.CARD_SQL}
SELECT page_id, board_id, url, title, description FROM ({_CUSTOM_KEPT})""")
def x4_custom_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _custom(spark, sf).select(*_COLUMNS)


_FRAME_POSTINGS = """
frame_postings AS (
  SELECT p_partkey AS k, p_partkey // 5 AS page_id, p_partkey // 100 AS board_id,
         CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'https://boards.example.io/co/jobs/' || p_partkey
              WHEN 1 THEN 'https://frames.example.io/co/team/jobs/' || p_partkey
              ELSE 'https://frames.example.io/embed/co/team/area/jobs/' || p_partkey END AS url,
         p_name AS title, p_type AS description
  FROM part  -- '/jobs/<n>' has too few slashes; '/co/team/jobs/<n>' and the longer one have four
  WHERE p_partkey % 3 <> 0 AND p_partkey % 5 > 0 AND p_partkey % 4 < 3
)"""


@query(f"""
WITH {_FRAME_POSTINGS}
SELECT page_id, board_id, url, title, description FROM frame_postings""")
def x5_frame_postings(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame_postings(_frames(spark, sf)).select(*_COLUMNS)


@query("""
SELECT o_orderkey // 20 AS page_id, o_custkey % 50 AS board_id, o_orderkey % 20 AS seq,
       'https://n' || (o_custkey % 50) || '.example.com/list/' || o_orderkey AS url,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderstatus
            ELSE 'Order ' || o_orderkey END AS title,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderstatus
            ELSE 'Order ' || o_orderkey END AS description
FROM orders WHERE o_orderkey % 5 > 1""")
def x6_navigation_postings(spark: SparkSession, sf: str) -> DataFrame:
    return X.navigation_postings(navigation_log(spark, sf))


@query(f"""
WITH {D.CARD_SQL}, {_FRAME_POSTINGS},
routed AS (
  SELECT *, CASE CAST(board_id % 4 AS INT) WHEN 1 THEN 'custom' WHEN 2 THEN 'frame'
            WHEN 3 THEN 'navigation' ELSE 'default' END AS route FROM cards
)
SELECT board_id, url, title, description FROM frame_postings WHERE board_id % 4 = 2
UNION ALL
SELECT board_id, url, CASE WHEN kind IN (0, 1, 2, 3, 5) THEN box_title ELSE link_text END,
       CASE WHEN kind IN (0, 1, 2, 3, 5) THEN box_text ELSE around END
FROM routed WHERE route = 'default' OR (route = 'frame'
  AND page_id NOT IN (SELECT page_id FROM frame_postings WHERE board_id % 4 = 2))
UNION ALL
SELECT board_id, url, title, description FROM ({_CUSTOM_KEPT}) WHERE board_id % 4 = 1
UNION ALL
SELECT o_custkey % 50, 'https://n' || (o_custkey % 50) || '.example.com/list/' || o_orderkey,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderstatus
            ELSE 'Order ' || o_orderkey END,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderstatus
            ELSE 'Order ' || o_orderkey END
FROM orders WHERE o_orderkey % 5 > 1 AND (o_custkey % 50) % 4 = 3
  AND o_custkey % 50 IN (SELECT board_id FROM parts)""")
def x7_route_postings(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("board_id")
    boards = D.part_boards(spark, sf).withColumns({
        "has_scraping_config": (b % 4 == 1) | (b % 4 == 3),
        "use_js_navigation": b % 4 == 3,
        "use_iframe": b % 4 != 0,
    })
    staged = stage_shredded(D.part_pages(spark, sf), boards, D.scratch_folder(spark))
    frames = stage_frames(spread(part_frames(spark, sf)), boards, D.scratch_folder(spark))
    rows = X.route_postings(
        staged, boards, D.custom_rules(spark), frames=frames, navigations=navigation_log(spark, sf)
    )
    return rows.select("board_id", "url", "title", "description")


@query(f"""
WITH {D.CARD_SQL}
SELECT board_id, url, title, CAST('custom' AS VARCHAR) AS flow FROM ({_CUSTOM_KEPT}) WHERE board_id % 5 = 3
UNION ALL
SELECT board_id, origin, 'Open roles', 'plugin' FROM cards WHERE board_id % 5 <> 3 GROUP BY board_id, origin, page_id""")
def f1_extractor_plugin(spark: SparkSession, sf: str) -> DataFrame:
    def headings(pages: DataFrame) -> DataFrame:
        head = F.get(F.filter("nodes", lambda n: n["tag"] == "h1"), F.lit(0))
        text = F.array_join(F.slice("texts", head["t_lo"] + 1, head["t_hi"] - head["t_lo"]), " ")
        return pages.select(
            "page_id", "board_id", F.lit(0).cast("long").alias("seq"),
            F.regexp_extract("base_url", "^[a-z]+://[^/]*", 0).alias("url"),
            text.alias("title"), F.lit("plugin").alias("description"),
        )

    rows = X.route_postings(
        D.part_shredded(spark, sf), D.part_boards(spark, sf), D.custom_rules(spark),
        extractors={"default": headings},
    )
    flow = F.when(F.col("description") == "plugin", "plugin").otherwise("custom")
    return rows.select("board_id", "url", "title", flow.alias("flow"))
