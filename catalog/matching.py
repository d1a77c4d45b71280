"""Boards, keywords and matching: K1-K6, M1-M6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.operators import boards as K
from boardwalk.operators import matching as M
from boardwalk.operators.shredding import spread
from boardwalk.schemas import LOCATION
from catalog import derived as D
from catalog.registry import registry

QUERIES, ORACLE, query = registry()


def _supplier_boards(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select(
        s.alias("board_id"),
        F.when(s % 2 == 0, D.fill("NATION_{n}", n=F.col("s_nationkey")))
        .otherwise(D.fill("Nation_{n}", n=F.col("s_nationkey"))).alias("name"),
        F.when(s % 3 == 0, F.lit("")).otherwise(D.fill("https://s{s}.example.com", s=s)).alias("job_board_url"),
        F.array(D.fill("Kw{n}", n=s % 7), F.lit("asia"), F.lit("Remote")).alias("keywords"),
    )


@query("SELECT s_suppkey AS board_id, s_nationkey FROM supplier WHERE s_nationkey = 3")
def k1_select_boards(spark: SparkSession, sf: str) -> DataFrame:
    boards = _supplier_boards(spark, sf).withColumn(
        "s_nationkey", F.substring_index("name", "_", -1).cast("int")
    )
    return K.select_boards(boards, "nation_3").select("board_id", "s_nationkey")


@query("""
SELECT DISTINCT s_suppkey AS board_id, lower(k) AS keyword FROM supplier,
  (SELECT 0) , unnest(['ASIA', 'Senior', 'kw1', 'Kw' || (s_suppkey % 7), 'asia', 'Remote']) AS u(k)""")
def k2_board_keywords(spark: SparkSession, sf: str) -> DataFrame:
    universal = F.array(F.lit("ASIA"), F.lit("Senior"), F.lit("kw1"))
    return K.board_keywords(_supplier_boards(spark, sf), universal)


@query("""
SELECT doc_id, keyword, count(*) AS n FROM (
  SELECT doc_id, regexp_replace(k, '^[\\s\\x{85}\\x{A0}]+|[\\s\\x{85}\\x{A0}]+$', '', 'g') AS keyword
  FROM (SELECT doc_id, unnest(string_split(text, ',')) AS k FROM documents)
) WHERE keyword <> '' GROUP BY ALL""")
def k3_clean_keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return K.clean_keyword_lists(docs, "text").groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT DISTINCT p_name AS keyword, min(p_partkey) AS pos FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS keyword, min(p_partkey) AS pos
      FROM part GROUP BY 1)
SELECT keyword, 0 AS part, pos FROM e
UNION ALL SELECT keyword, 1, pos FROM n WHERE keyword NOT IN (SELECT keyword FROM e)""")
def k4_merge_universal(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = D.table(spark, sf, "part")
    existing = part.filter(k % 3 == 0).select(k.alias("pos"), F.col("p_name").alias("keyword"))
    new = part.select(
        k.alias("pos"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("keyword")
    )
    return K.merge_universal(existing, new)


@query("""
SELECT name, count(*) AS n FROM (
  SELECT c_mktsegment AS name FROM customer UNION ALL SELECT n_name FROM nation
  UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0
) GROUP BY 1""")
def k5_append_boards(spark: SparkSession, sf: str) -> DataFrame:
    customer = D.table(spark, sf, "customer")
    boards = customer.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("board_id"))
    new = D.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    again = customer.filter("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("name"))
    rows = K.append_boards(K.append_boards(boards, new), again)
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS board_id FROM supplier WHERE s_suppkey % 3 <> 0")
def k6_scrapable_boards(spark: SparkSession, sf: str) -> DataFrame:
    return K.scrapable_boards(_supplier_boards(spark, sf)).select("board_id")


@query("""
WITH last AS (
  SELECT event_type, user_id, arg_max(value, event_id) AS title, arg_max(props, event_id) AS description,
         min(event_id) AS first_id FROM events GROUP BY 1, 2
)
SELECT event_type AS board_id, 'u' || user_id AS url, title, description,
       CAST(first_id // 100 AS BIGINT) AS page_no, CAST(first_id % 100 AS BIGINT) AS seq FROM last""")
def m1_dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    postings = D.table(spark, sf, "events").select(
        F.col("event_type").alias("board_id"), D.fill("u{u}", u=F.col("user_id")).alias("url"),
        (e / 100).cast("long").alias("page_no"), (e % 100).alias("seq"),
        F.col("value").alias("title"), F.col("props").alias("description"),
    )
    return M.dedup_last(postings)


# --- documents as postings: the source is the board -----------------------------------------

_OWN_WORDS = ["für", "que la", "of the", "de", "état", "und die", "no-such", "th"]


def _doc_postings(spark: SparkSession, sf: str) -> DataFrame:
    board = F.regexp_extract("source", "([0-9]+)$", 1).cast("long")
    return spread(D.table(spark, sf, "documents")).select(
        board.alias("board_id"), D.fill("https://docs.example.com/{d}", d=F.col("doc_id")).alias("url"),
        F.col("lang").alias("title"), F.col("text").alias("description"),
        (F.col("doc_id") % 10).alias("page_no"), F.col("doc_id").alias("seq"),
    )


def _doc_boards(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("board_id")
    board = F.regexp_extract("source", "([0-9]+)$", 1).cast("long")
    ids = D.table(spark, sf, "documents").select(board.alias("board_id")).distinct()
    own = F.get(F.array(*[F.lit(w) for w in _OWN_WORDS]), (b % len(_OWN_WORDS)).cast("int"))
    location = (
        F.when(b % 3 == 0, F.lit('{"include": ["THE ", "für", ""]}'))
        .when(b % 3 == 1, F.lit('{"include": [], "exclude": ["", "Est "]}'))
    )
    return ids.select(
        b, D.fill("src{b}", b=b).alias("name"), F.lit("https://docs.example.com").alias("job_board_url"),
        F.array(own, F.lit("DES")).alias("keywords"),
        F.from_json(location, LOCATION).alias("location_filters"),
    )


_UNIVERSAL = ["the", "des", "Est"]


def _doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    universal = F.array(*[F.lit(w) for w in _UNIVERSAL])
    return K.board_keywords(_doc_boards(spark, sf), universal)


_DOCS = """
docs AS (
  SELECT CAST(substring(source, 4) AS BIGINT) AS board_id, doc_id,
         'https://docs.example.com/' || doc_id AS url, lang AS title,
         lower(lang || ' ' || text) AS body FROM documents
), placed AS (
  SELECT *, CASE WHEN board_id % 3 = 0 THEN NOT (contains(body, 'the ') OR contains(body, 'für'))
                 WHEN board_id % 3 = 1 THEN contains(body, 'est ') ELSE false END AS dropped FROM docs
)"""
_OWN_SQL = "[" + ", ".join(f"'{w}'" for w in _OWN_WORDS) + "]"
_HITS = f"""{_DOCS}, kw AS (
  SELECT DISTINCT board_id, lower(keyword) AS keyword FROM (
    SELECT DISTINCT board_id, unnest(['the', 'des', 'Est', {_OWN_SQL}[board_id % {len(_OWN_WORDS)} + 1], 'DES']) AS keyword
    FROM docs)
), hits AS (
  SELECT board_id, url, keyword FROM docs JOIN kw USING (board_id)
  WHERE {D.edge_sql('body', "replace(keyword, '-', '\\-')")}
)"""


@query(f"WITH {_DOCS} SELECT board_id, url FROM placed WHERE NOT dropped")
def m2_location_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.location_filter(_doc_postings(spark, sf), _doc_boards(spark, sf))
    return rows.select("board_id", "url")


@query(f"WITH {_HITS} SELECT board_id, url, keyword FROM hits")
def m3_keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return M.keyword_hits(_doc_postings(spark, sf), _doc_keywords(spark, sf), strategy="scan")


@query(f"WITH {_HITS} SELECT board_id, url, keyword FROM hits")
def m3_keyword_hits_by_token(spark: SparkSession, sf: str) -> DataFrame:
    return M.keyword_hits(_doc_postings(spark, sf), _doc_keywords(spark, sf), strategy="token")


@query(f"WITH {_HITS} SELECT board_id, url, keyword FROM hits")
def m3_keyword_hits_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken when the keyword table is too large to broadcast."""
    return M.keyword_hits(
        _doc_postings(spark, sf), _doc_keywords(spark, sf), strategy="token", small=False
    )


@query(f"""
WITH words AS (SELECT DISTINCT lower(p_name) AS keyword FROM part
               UNION SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
turns AS (SELECT conv_id, turn, lower(role || ' ' || text) AS body FROM conversations)
SELECT conv_id, turn, keyword FROM turns JOIN words ON contains(body, keyword)
WHERE regexp_matches(body,
  CASE WHEN regexp_matches(keyword, '^[\\p{{L}}\\p{{N}}_]') THEN '(^|[^\\p{{L}}\\p{{N}}_])' ELSE '[\\p{{L}}\\p{{N}}_]' END
  || regexp_escape(keyword) ||
  CASE WHEN regexp_matches(keyword, '[\\p{{L}}\\p{{N}}_]$') THEN '([^\\p{{L}}\\p{{N}}_]|$)' ELSE '[\\p{{L}}\\p{{N}}_]' END)""")
def m3_large_keyword_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the benchmark texts, punctuation included, as a keyword of one board, on
    conversation turns. A keyword has a word edge at both ends, also where it ends in a full stop."""
    words = D.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    words = words.filter("w <> ''").select(F.lower("w").alias("keyword"))
    names = D.table(spark, sf, "part").select(F.lower("p_name").alias("keyword"))
    keywords = words.unionByName(names).distinct().select(F.lit(0).cast("long").alias("board_id"), "keyword")
    turns = spread(D.table(spark, sf, "conversations")).select(
        F.lit(0).cast("long").alias("board_id"), "conv_id", "turn",
        F.col("role").alias("title"), F.col("text").alias("description"),
    )
    return M.keyword_hits(turns, keywords, key=["conv_id", "turn"])


@query(f"""
WITH {_HITS}
SELECT d.board_id, d.url, d.title, d.doc_id % 10 AS page_no, d.doc_id AS seq,
       string_agg(keyword, ',' ORDER BY keyword) AS keywords
FROM docs d JOIN hits USING (board_id, url) GROUP BY ALL""")
def m4_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.matches(_doc_postings(spark, sf), _doc_keywords(spark, sf))
    return rows.withColumn("keywords", F.array_join("matched_keywords", ",")).drop("matched_keywords")


@query(f"""
WITH {_HITS}, grouped AS (
  SELECT board_id, url, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM hits GROUP BY ALL
)
SELECT p.board_id, p.url, p.dropped, CASE WHEN dropped THEN '' ELSE coalesce(keywords, '') END AS keywords
FROM placed p LEFT JOIN grouped USING (board_id, url)""")
def m4_match_in_place(spark: SparkSession, sf: str) -> DataFrame:
    return _in_place(spark, sf).select(
        "board_id", "url", "dropped", F.array_join("matched_keywords", ",").alias("keywords")
    )


def _in_place(spark: SparkSession, sf: str) -> DataFrame:
    universal = F.array(*[F.lit(w) for w in _UNIVERSAL])
    return M.match_in_place(_doc_postings(spark, sf), _doc_boards(spark, sf), universal)


@query(f"""
WITH {_HITS}, hit_urls AS (SELECT DISTINCT board_id, url FROM hits),
extra AS (SELECT DISTINCT board_id FROM docs UNION SELECT 1000 + n_nationkey FROM nation)
SELECT e.board_id, CASE WHEN e.board_id < 1000 THEN 'src' || e.board_id ELSE 'none' END AS name,
       count(p.url) AS listings, count(p.url) FILTER (p.dropped) AS dropped,
       count(p.url) FILTER (NOT p.dropped AND h.url IS NOT NULL) AS matched
FROM extra e LEFT JOIN placed p USING (board_id) LEFT JOIN hit_urls h ON h.board_id = p.board_id AND h.url = p.url
GROUP BY 1, 2""")
def m5_board_funnel(spark: SparkSession, sf: str) -> DataFrame:
    empty = D.table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1000).cast("long").alias("board_id"), F.lit("none").alias("name")
    )
    boards = _doc_boards(spark, sf).select("board_id", "name").unionByName(empty)
    flagged = _in_place(spark, sf).withColumn("matched", F.size("matched_keywords") > 0)
    return M.board_funnel(boards, flagged)


@query(f"""
WITH {_HITS} SELECT board_id, url, count(*) AS n FROM (
  SELECT DISTINCT board_id, url FROM hits WHERE board_id % 2 = 0
  UNION ALL SELECT DISTINCT board_id, url FROM hits WHERE board_id % 2 = 1
) GROUP BY ALL""")
def m6_all_matches(spark: SparkSession, sf: str) -> DataFrame:
    postings, keywords = _doc_postings(spark, sf), _doc_keywords(spark, sf)
    parts = [
        M.matches(postings.filter(F.col("board_id") % 2 == i), keywords).select("board_id", "url")
        for i in (0, 1)
    ]
    return M.all_matches(*parts).groupBy("board_id", "url").agg(F.count("*").alias("n"))
