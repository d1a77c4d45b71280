"""Scans, elements and links: S2, S3, S4, S5, E1-E6, U1-U10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.functions import urls
from boardwalk.functions.fixed import JOB_URL_PATTERNS, rule
from boardwalk.operators import containers as C
from boardwalk.operators import links as L
from boardwalk.operators.history import history_from_report
from boardwalk.operators.shredding import drop_chrome, elements, shred, spread
from boardwalk.sources import tables as S
from catalog import derived as D
from catalog.registry import registry

QUERIES, ORACLE, query = registry()


def _shredded(spark: SparkSession, sf: str) -> DataFrame:
    return shred(spread(D.table(spark, sf, "pages")))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return L.resolve_links(L.scan_hrefs(spread(D.table(spark, sf, "pages"))))


# hrefs of driver pages are root-relative words
_LINKS = """
links AS (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin
  FROM pages
), resolved AS (SELECT *, origin || href AS url FROM links)"""


@query("""
WITH hosts AS (
  SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, min(page_id) AS board_id FROM pages GROUP BY 1
)
SELECT page_id, h.board_id, url FROM pages p
JOIN hosts h ON h.host = regexp_extract(p.url, '//([^/?#]*)', 1)""")
def s2_read_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "pages")
    boards = pages.groupBy(urls.host(F.col("url")).alias("h")).agg(F.min("page_id").alias("board_id"))
    boards = boards.select("board_id", F.concat(F.lit("https://"), "h", F.lit("/careers")).alias("job_board_url"))
    return S.read_pages(spark, f"{sf}/pages.parquet", boards).select("page_id", "board_id", "url")


def part_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame documents made of parts: the main document and one frame per part; every third
    frame speaks of no job at all, and link forms differ."""
    k = F.col("p_partkey")
    href = (
        F.when(k % 4 == 0, D.fill("https://boards.example.io/co/jobs/{k}", k=k))
        .when(k % 4 == 1, D.fill("/co/team/jobs/{k}", k=k))
        .when(k % 4 == 2, D.fill("co/team/area/jobs/{k}", k=k))
        .otherwise(D.fill("/jobs/{k}", k=k))
    )
    html = F.concat(
        F.when(k % 3 == 0, F.lit("<p>Listed</p>")).otherwise(F.lit("<p>Every job</p>")),
        D.fill(
            '<nav><div class="opening"><a href="{h}"><h3>{n}</h3></a><div>{t}</div>'
            "<p>{b}</p></div></nav>",
            h=href, n=F.col("p_name"), t=F.col("p_type"), b=F.col("p_brand"),
        ),
    )
    return D.table(spark, sf, "part").select(
        (k / 5).cast("long").alias("page_id"), (k / 100).cast("long").alias("board_id"),
        (k % 5).cast("int").alias("frame_no"),
        D.fill("https://frames.example.io/embed/p{k}?for=a", k=k).alias("frame_url"),
        html.alias("html"),
    )


@query("""
SELECT p_partkey // 5 AS page_id, CAST(p_partkey % 5 AS INT) AS frame_no,
       'https://frames.example.io/embed/p' || p_partkey || '?for=a' AS frame_url
FROM part WHERE p_partkey % 5 > 0""")
def s3_read_frames(spark: SparkSession, sf: str) -> DataFrame:
    folder = D.scratch_folder(spark)
    part_frames(spark, sf).write.parquet(folder)
    return S.read_frames(spark, folder).select("page_id", "frame_no", "frame_url")


def navigation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks on order cards: some land nowhere, some on a folder, some have no title."""
    k = F.col("o_orderkey")
    start = D.fill("https://n{c}.example.com/list", c=F.col("o_custkey") % 50)
    return D.table(spark, sf, "orders").select(
        (k / 20).cast("long").alias("page_id"), (F.col("o_custkey") % 50).alias("board_id"),
        (k % 20).alias("seq"), start.alias("initial_url"),
        F.when(k % 3 == 0, F.lit("  ")).otherwise(D.fill(" Order {k} ", k=k)).alias("title_text"),
        D.fill("\n{p} {s}\t", p=F.col("o_orderpriority"), s=F.col("o_orderstatus")).alias("container_text"),
        F.when(k % 5 == 0, start).when(k % 5 == 1, F.concat(start, F.lit("/")))
        .otherwise(F.concat(start, F.lit("/"), k.cast("string"))).alias("landed_url"),
    )


@query("""
SELECT o_orderkey // 20 AS page_id, o_orderkey % 20 AS seq,
       'https://n' || (o_custkey % 50) || '.example.com/list' AS initial_url
FROM orders""")
def s4_read_navigations(spark: SparkSession, sf: str) -> DataFrame:
    folder = D.scratch_folder(spark)
    navigation_log(spark, sf).write.parquet(folder)
    return S.read_navigations(spark, folder).select("page_id", "seq", "initial_url")


@query("""
SELECT DISTINCT 'https://c.example.com/jobs/' || (c_custkey // 2) AS url FROM customer
WHERE c_custkey % 3 <> 2""")
def s5_history_from_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    link = D.fill(
        '<td><a href="https://c.example.com/jobs/{j}" target="_blank" class="{c}">{n}</a></td>',
        j=(k / 2).cast("long"), n=F.col("c_name"),
        c=F.when(k % 3 == 0, "job-link").when(k % 3 == 1, "big job-link").otherwise("job-links"),
    )
    reports = D.table(spark, sf, "customer").groupBy((k / 40).cast("long").alias("page_id")).agg(
        F.array_join(F.collect_list(link), "").alias("html")
    )
    return history_from_report(shred(reports.select("page_id", F.lit("r").alias("url"), "html")))


_CLEAN = "regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g'), '<!--.*?-->', '', 'g')"
_IN_CHROME = "regexp_extract_all({h}, '(?s)<{t}>(.*?)</{t}>', 1)"


@query(f"""
WITH clean AS (SELECT page_id, {_CLEAN} AS h FROM pages),
bits AS (
  SELECT page_id, regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1) AS tags,
         regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM clean
)
SELECT page_id, CAST(len(tags) AS BIGINT) AS n_nodes,
       CAST(len(list_filter(tags, lambda t: t = 'p')) AS BIGINT) AS n_p,
       CAST(len(regexp_extract_all(nav, '<[a-z]')) AS BIGINT) AS n_chrome,
       CAST(len(tags) - 1 AS BIGINT) AS root_last
FROM bits""")
def e1_shred(spark: SparkSession, sf: str) -> DataFrame:
    def size(test):
        return F.size(F.filter("nodes", test)).cast("long")

    return _shredded(spark, sf).select(
        "page_id", F.size("nodes").cast("long").alias("n_nodes"),
        size(lambda n: n["tag"] == "p").alias("n_p"),
        size(lambda n: n["in_chrome"]).alias("n_chrome"),
        F.get("nodes", F.lit(0))["last"].cast("long").alias("root_last"),
    )


@query("""
WITH t AS (
  SELECT page_id, unnest(['title', 'h1']) AS tag,
         unnest([regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
                 regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)]) AS raw
  FROM pages
)
SELECT page_id, tag,
       trim(regexp_replace(regexp_replace(raw, '&quot;', '"', 'g'), '&amp;?', '&', 'g')) AS text
FROM t""")
def e2_subtree_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = elements(_shredded(spark, sf), "page_id")
    return rows.filter(F.col("tag").isin("title", "h1")).select("page_id", "tag", "text")


@query(f"""
WITH clean AS (SELECT page_id, {_CLEAN} AS h FROM pages),
kept AS (SELECT page_id, regexp_replace(h, '(?s)<nav>.*?</nav>', '<nav></nav>', 'g') AS h FROM clean)
SELECT page_id, tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM kept)
GROUP BY 1, 2""")
def e3_drop_chrome(spark: SparkSession, sf: str) -> DataFrame:
    rows = drop_chrome(elements(_shredded(spark, sf), "page_id"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"""
WITH {_LINKS}, numbered AS (
  SELECT page_id, href, row_number() OVER (PARTITION BY page_id) AS i FROM links
), ad AS (
  SELECT page_id, 0 AS rank, NULL AS href FROM pages WHERE html LIKE '%<div class="ad">%'
)
SELECT page_id, rank, href, count(*) AS n FROM (
  SELECT page_id, rank, href FROM ad
  UNION ALL SELECT page_id, 1, href FROM links WHERE contains(href, 'an')
  UNION ALL SELECT page_id, 2, href FROM links WHERE lower(href) LIKE '/t%'
) GROUP BY ALL""")
def e4_select_elements(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        rule(0, "div", class_eq="ad"),
        rule(1, "a", attr="href", op="*=", value="an", ancestor_tag="nav"),
        rule(1, "li", id_eq="none"),
        rule(2, "a", attr="href", op="^=", value="/T", ci=True, last_child=True),
    ]
    return C.select_elements(_shredded(spark, sf), rules).groupBy("page_id", "rank", "href").agg(
        F.count("*").alias("n")
    )


@query(f"WITH {_LINKS} SELECT page_id, page_url, href, count(*) AS n FROM links GROUP BY ALL")
def e5_page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.page_links(_shredded(spark, sf)).filter("in_chrome")
    return rows.groupBy("page_id", "page_url", "href").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT page_id, page_url, href, count(*) AS n FROM links GROUP BY ALL")
def e5_scan_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.scan_hrefs(spread(D.table(spark, sf, "pages")))
    return rows.groupBy("page_id", "page_url", "href").agg(F.count("*").alias("n"))


@query(f"""
WITH {D.CARD_SQL}
SELECT page_id, CAST(code AS INT) AS code,
       CASE kind WHEN 1 THEN '/positions/' || k || '?src=list' ELSE '/jobs/' || k END AS href
FROM cards WHERE kind IN (0, 1, 2, 7)""")
def e6_first_link(spark: SparkSession, sf: str) -> DataFrame:
    return C.keyword_containers(D.part_shredded(spark, sf)).select("page_id", "code", "href")


@query(f"WITH {_LINKS} SELECT page_id, href, url, count(*) AS n FROM resolved GROUP BY ALL")
def u1_resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).groupBy("page_id", "href", "url").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT p_partkey AS k, 'https://b' || (p_partkey // 100) || '.example.com' AS o FROM part)
SELECT k, CASE CAST(k % 8 AS INT)
  WHEN 0 THEN o || '/a/b/x/' || k WHEN 1 THEN o || '/a/x/' || k
  WHEN 2 THEN o || '/a/b/list?q=' || k WHEN 3 THEN o || '/a/b/list?q=1#f' || k
  WHEN 4 THEN 'https://cdn' || k || '.example.net/p' WHEN 5 THEN 'mailto:p' || k || '@example.com'
  WHEN 6 THEN o || '/' || k || '/' ELSE '' END AS url
FROM h""")
def u1_resolve_forms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    forms = ["x/{k}", "../x/{k}", "?q={k}", "#f{k}", "//cdn{k}.example.net/p",
             "mailto:p{k}@example.com", "./../../../{k}/", ""]
    href = F.coalesce(*[F.when(k % 8 == i, D.fill(f, k=k)) for i, f in enumerate(forms)])
    page = D.fill("https://b{b}.example.com/a/b/list?q=1", b=(k / 100).cast("long"))
    links = D.table(spark, sf, "part").select(k.alias("k"), href.alias("href"), page.alias("page_url"))
    return L.resolve_links(links).select("k", "url")


@query("""
SELECT p_partkey AS k, CASE CAST(p_partkey % 4 AS INT)
  WHEN 0 THEN 'https://boards.example.io/co/jobs/' || p_partkey
  WHEN 1 THEN 'https://frames.example.io/co/jobs/' || p_partkey
  WHEN 2 THEN 'https://frames.example.io/embed/jobs/' || p_partkey
  ELSE 'https://frames.example.io/e/' || p_partkey || '?u=a/x' END AS url
FROM part""")
def u2_resolve_frame_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    links = D.table(spark, sf, "part").select(
        k.alias("k"),
        F.when(k % 4 == 0, D.fill("https://boards.example.io/co/jobs/{k}", k=k))
        .when(k % 4 == 1, D.fill("/co/jobs/{k}", k=k))
        .when(k % 4 == 2, D.fill("jobs/{k}", k=k)).otherwise(F.lit("x")).alias("href"),
        F.when(k % 4 == 3, D.fill("https://frames.example.io/e/{k}?u=a/b", k=k))
        .otherwise(F.lit("https://frames.example.io/embed/list")).alias("frame_url"),
    )
    return L.resolve_frame_links(links).select("k", "url")


@query("""
SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages""")
def u3_link_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return L.link_hosts(D.table(spark, sf, "pages")).select("page_id", "host", "origin")


@query("SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS url_key FROM pages")
def u4_normalize_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.normalize_links(D.table(spark, sf, "pages")).select("page_id", "url_key")


def _self_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every page to the directory of its own URL, to itself, and to a query of it."""
    return D.table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("page_url"),
        F.explode(F.array(
            F.concat(F.substring_index("url", "?", 1), F.lit("?page=9")),
            F.concat("url", F.lit("/sub")), F.concat(F.lit("ftp:"), "url"),
            F.concat(F.substring_index("url", "?", 1), F.lit("//")),
        )).alias("url"),
    )


_SELF = """
self AS (
  SELECT page_id, url AS page_url, unnest([split_part(url, '?', 1) || '?page=9', url || '/sub',
         'ftp:' || url, split_part(url, '?', 1) || '//']) AS url FROM pages)"""


@query(f"""
WITH {_SELF}
SELECT page_id, url FROM self
WHERE rtrim(split_part(url, '?', 1), '/') <> rtrim(split_part(page_url, '?', 1), '/')""")
def u5_drop_self_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.drop_self_links(_self_links(spark, sf)).select("page_id", "url")


@query(f"WITH {_SELF} SELECT page_id, url FROM self WHERE url LIKE 'http%'")
def u6_http_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.http_links(_self_links(spark, sf)).select("page_id", "url")


_JOBS = " OR ".join(f"contains(lower(url), '{p}')" for p in JOB_URL_PATTERNS)


@query(f"""
WITH h AS (SELECT p_partkey AS k, 'https://b' || (p_partkey % 7) || '.example.com' AS o,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '/Jobs/' WHEN 1 THEN '/job-' WHEN 2 THEN '/careers/x'
       WHEN 3 THEN '/about/' ELSE '/x/roles/' END AS path FROM part),
l AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'https://b0.example.com' ELSE o END || path || k AS url,
      o FROM h)
SELECT k, url FROM l WHERE regexp_extract(url, '^[a-z]+://[^/]*') <> o OR {_JOBS}""")
def u7_job_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    own = D.fill("https://b{h}.example.com", h=k % 7)
    paths = ["/Jobs/", "/job-", "/careers/x", "/about/", "/x/roles/"]
    path = F.coalesce(*[F.when(k % 5 == i, F.lit(p)) for i, p in enumerate(paths)])
    links = D.table(spark, sf, "part").select(
        k.alias("k"), own.alias("page_url"),
        F.concat(F.when(k % 3 == 0, F.lit("https://b0.example.com")).otherwise(own), path,
                 k.cast("string")).alias("url"),
    )
    return L.job_links(links).select("k", "url")


@query(f"""
WITH {_LINKS}
SELECT page_id, url, count(*) AS n FROM resolved
WHERE NOT (contains(url, '/Th') OR contains(url, 'en$') OR contains(url, ','))
GROUP BY ALL""")
def u8_exclude_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.exclude_links(_resolved(spark, sf), ["/Th", "en$", ","])
    return rows.groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS k FROM part
WHERE p_partkey % 3 <> 0 AND NOT (p_partkey % 3 = 1 AND p_brand LIKE '%1')""")
def u9_drop_search_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    url = (
        F.when(k % 3 == 0, F.lit("https://a.example.com/x/search?q=1"))
        .when((k % 3 == 1) & F.endswith("p_brand", F.lit("1")), F.lit("https://a.example.com/filters"))
        .otherwise(F.lit("https://a.example.com/Search"))
    )
    return L.drop_search_links(D.table(spark, sf, "part").select(k.alias("k"), url.alias("url"))).select("k")


@query("""
SELECT page_id, url AS href FROM pages WHERE length(url) - length(replace(url, '/', '')) >= 4""")
def u10_deep_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.deep_links(D.table(spark, sf, "pages").select("page_id", F.col("url").alias("href")))
