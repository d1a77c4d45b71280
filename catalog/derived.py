"""Inputs Spark derives from the driver tables, and the same tables as SQL for the oracle.

``part`` becomes crawled boards: 25 parts make a page, four pages make a board. Every part turns
into one card, of one of eight kinds, so that each way of selecting a posting has its share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.functions.fixed import RULE_FIELDS, rule
from boardwalk.operators.shredding import shred
from boardwalk.schemas import SELECTOR_RULES
from boardwalk.session import shared_folder, tune

CARDS = [
    '<div class="job-card"><h3><a href="/jobs/{k}">{n}</a></h3><p>{t}</p><p class="loc">{b}</p></div>',
    '<li class="posting-row"><a href="/positions/{k}?src=list">{n} {t}</a><span>{b}</span></li>',
    '<article id="position-{k}"><a href="/jobs/{k}"></a><span class="item-title">{n}</span> <p>{t}</p></article>',
    '<table><tr><td>{b}</td><td><a href="/roles/{k}">{n}</a></td><td>{t}</td></tr></table>',
    '<section><a href="/openings/{k}">{n}</a> {t}</section>',
    '<li data-qa="searchResultItem"><h4>{n}</h4><a href="https://other.example.org/x/{k}">go</a><p>{t}</p></li>',
    '<li data-qa="talentResultItem"><a href="/jobs/{k}">{n}</a> {t}</li>',
    '<div class="job-card"><h3>Newsletter {n}</h3><a href="/jobs/{k}">{n}</a></div>',
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the one all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def fill(template: str, **columns: Column) -> Column:
    """Put columns into the {holes} of a template."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.col("p_name").alias("n"), F.col("p_type").alias("t"),
        F.col("p_brand").alias("b"), (k / 25).cast("long").alias("page_id"),
        (k % 8).cast("int").alias("kind"),
    )


def _crawl(cards: DataFrame, heading: str) -> DataFrame:
    """Pages of 25 cards each with pagination links and a footer card that must not count."""
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "\n"
    )
    # a number of partitions that is asked for is not coalesced, so shredding stays parallel
    slots = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = cards.repartition(slots, "page_id").groupBy("page_id").agg(body.alias("body")).withColumns({
        "board_id": (F.col("page_id") / 4).cast("long"),
        "no": (F.col("page_id") % 4 + 1).cast("int"),
    })
    origin = fill("https://b{b}.example.com", b=F.col("board_id"))
    following = fill(
        '<a href="/careers?page=1" aria-label="Back">to the start</a>'
        '<a href="/careers?page={n}" aria-label="Next">one more leaf</a>',
        n=F.col("no") + 1,
    )
    html = F.concat(
        F.lit(f"<html><head><title>{heading}</title><style>li{{margin:0}}</style></head><body>"
              f"<h1>{heading}</h1><main>"),
        F.col("body"),
        F.lit('</main><menu id="leaves">'),
        F.when(F.col("no") < 4, following).otherwise(F.lit("")),
        F.lit('</menu><footer><div class="job-card"><a href="/jobs/0">Footer job</a></div></footer>'
              "</body></html>"),
    )
    return pages.select(
        "page_id", "board_id",
        F.concat(
            origin, F.lit("/careers"),
            F.when(F.col("no") > 1, fill("?page={n}", n=F.col("no"))).otherwise(F.lit("")),
        ).alias("url"),
        html.alias("html"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    holes = {c: F.col(c) for c in "kntb"}
    card = F.coalesce(*[
        F.when(F.col("kind") == i, fill(c, **holes)) for i, c in enumerate(CARDS)
    ])
    return _crawl(parts.select("page_id", "k", card.alias("card")), "Open roles")


def part_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(part_pages(spark, sf_dir))


def part_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of the part pages: every second has a page limit of 3; keywords and location
    filters differ by board; boards with id % 5 = 3 have a scraping configuration."""
    b = F.col("board_id")
    ids = _parts(spark, sf_dir).select((F.col("page_id") / 4).cast("long").alias("board_id")).distinct()
    strings = "array<string>"
    none = F.array().cast(strings)

    def words(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return ids.select(
        b,
        fill("Board {b}", b=b).alias("name"),
        fill("https://b{b}.example.com/careers", b=b).alias("job_board_url"),
        F.when(b % 3 == 0, words("Widget")).when(b % 3 == 1, words("gizmo", "promo"))
        .otherwise(none).alias("keywords"),
        F.when(b % 4 == 1, F.struct(none.alias("include"), words("brand#1", "").alias("exclude")))
        .when(b % 4 == 2, F.struct(words("SMALL", "brand#2").alias("include"),
                                   F.lit(None).cast(strings).alias("exclude")))
        .alias("location_filters"),
        F.lit(False).alias("use_iframe"),
        F.when(b % 2 == 0, 3).otherwise(10).alias("max_pages"),
        (b % 5 == 3).alias("has_scraping_config"),
        F.lit(False).alias("use_js_navigation"),
        words("/jobs/1").alias("exclude_urls"),
        words("hot", "Red").alias("exclude_titles"),
        F.lit(None).cast(strings).alias("pagination_selectors"),
    )


UNIVERSAL = ["red", "Small"]


def universal() -> Column:
    return F.array(*[F.lit(w) for w in UNIVERSAL])


def custom_rules(spark: SparkSession) -> DataFrame:
    """Rules shared by all boards that have a scraping configuration."""
    rows = [
        ("container", rule(0, "div", class_eq="missing")),
        ("container", rule(1, "li", class_eq="posting-row")),
        ("container", rule(1, "div", class_eq="job-card")),
        ("container", rule(2, "article")),
        ("title", rule(0, "h3")),
        ("description", rule(0, attr="class", op="^=", value="lo")),
    ]
    return spark.createDataFrame(
        [(s, None, *[r[f] for f in RULE_FIELDS]) for s, r in rows], SELECTOR_RULES
    )


def rules_for(boards: DataFrame, rule_set: str, *test, **tests) -> DataFrame:
    """One rule for each of some boards."""
    one = rule(0, *test, **tests)
    kinds = {f.name: f.dataType for f in SELECTOR_RULES.fields}
    return boards.select(
        F.lit(rule_set).alias("rule_set"), "board_id", *[F.lit(one[f]).cast(kinds[f]).alias(f) for f in RULE_FIELDS])


# --- the same as SQL ---------------------------------------------------------------------

PARTS_SQL = """
parts AS (
  SELECT p_partkey AS k, p_name AS n, p_type AS t, p_brand AS b,
         p_partkey // 25 AS page_id, p_partkey // 100 AS board_id,
         CAST(p_partkey % 8 AS INT) AS kind,
         'https://b' || (p_partkey // 100) || '.example.com' AS origin,
         CAST((p_partkey // 25) % 4 + 1 AS INT) AS no
  FROM part
)"""

# what each kind of card yields: container title and text, direct-link title and text
CARD_SQL = PARTS_SQL + """,
cards AS (
  SELECT *, CASE kind WHEN 1 THEN origin || '/positions/' || k || '?src=list'
                      WHEN 3 THEN origin || '/roles/' || k
                      WHEN 4 THEN origin || '/openings/' || k
                      WHEN 5 THEN 'https://other.example.org/x/' || k
                      ELSE origin || '/jobs/' || k END AS url,
    CASE kind WHEN 0 THEN 72 WHEN 1 THEN 64 WHEN 2 THEN 5 WHEN 3 THEN 114
              WHEN 5 THEN 108 WHEN 7 THEN 72 END AS code,
    CASE kind WHEN 1 THEN n || ' ' || t WHEN 7 THEN 'Newsletter ' || n ELSE n END AS box_title,
    CASE kind WHEN 0 THEN n || ' ' || t || ' ' || b
              WHEN 1 THEN n || ' ' || t || ' ' || b
              WHEN 2 THEN n || ' ' || t
              WHEN 3 THEN b || ' ' || n || ' ' || t
              WHEN 5 THEN n || ' go ' || t
              WHEN 7 THEN 'Newsletter ' || n || ' ' || n END AS box_text,
    CASE kind WHEN 1 THEN n || ' ' || t WHEN 2 THEN '' WHEN 5 THEN 'go' ELSE n END AS link_text,
    CASE kind WHEN 0 THEN n WHEN 1 THEN n || ' ' || t || ' ' || b WHEN 2 THEN n || ' ' || t
              WHEN 3 THEN n WHEN 4 THEN n || ' ' || t WHEN 5 THEN n || ' go ' || t
              WHEN 6 THEN n || ' ' || t WHEN 7 THEN 'Newsletter ' || n || ' ' || n END AS around
  FROM parts
)"""

POSTINGS_SQL = CARD_SQL + """,
postings AS (
  SELECT page_id, board_id, no, k, kind, url, b, t, n,
         CASE WHEN kind IN (0, 1, 2, 3, 5) THEN box_title ELSE link_text END AS title,
         CASE WHEN kind IN (0, 1, 2, 3, 5) THEN box_text ELSE around END AS description
  FROM cards
)"""

BOARDS_SQL = """,
boards AS (
  SELECT DISTINCT board_id, 'Board ' || board_id AS name,
         origin || '/careers' AS job_board_url,
         CASE WHEN board_id % 2 = 0 THEN 3 ELSE 10 END AS max_pages,
         board_id % 5 = 3 AS has_config
  FROM parts
)"""

# the word edge test for keywords that begin and end with a word character
EDGE_SQL = "regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])' || {kw} || '([^\\p{{L}}\\p{{N}}_]|$)')"


def edge_sql(text: str, keyword: str) -> str:
    return EDGE_SQL.format(text=text, kw=keyword)
