from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardwalk.functions import urls

BASES = [
    "https://x.example.com", "https://x.example.com/", "http://X.example.com:8080/a/b/c?q=1#top",
    "https://u:p@x.example.com/a/b/", "https://x.example.com/a//b/c", "HTTPS://x.example.com/a?b/c",
]
HREFS = [
    "", "/jobs/1", "jobs/1", "./a", "../a", "../../../a", "/../a", "/a/./b/../c", "?q=2", "#f", "#",
    "?", "//cdn.example.net/p", "//cdn.example.net", "mailto:a@example.com", "javascript:void(0)",
    "http://o.example.org/x/../y", "https:foo", "  /lead", "/trail ", "a b", "/a\nb", "a//b", "..",
    ".", "/", "x?y=1#z", "x?#", "ftp://f.example.org/a", "HTTP://o.example.org", "/jobs//2", "a/", "/.",
]


def join_all(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, b string")
    return [r[0] for r in df.select(urls.resolve(F.col("h"), F.col("b")).alias("u")).collect()]


def python_join(href, base):
    return urljoin(base, href) if href else href


def test_resolve_known_forms(spark):
    pairs = [(h, b) for h in HREFS for b in BASES]
    expected = [python_join(*p) for p in pairs]
    assert list(zip(pairs, join_all(spark, pairs))) == list(zip(pairs, expected))


PIECES = st.lists(st.sampled_from(["/", "..", ".", "a", "b", "?", "#", "q=1"]), max_size=7).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(PIECES, PIECES), min_size=40, max_size=60))
def test_resolve_random_forms(spark, pieces):
    pairs = [(h, "https://x.example.com/" + b) for h, b in pieces if not h.startswith("//")]
    assert join_all(spark, pairs) == [python_join(*p) for p in pairs]


def test_host_and_origin(spark):
    values = [*BASES, "//h.example.com/x", "mailto:a@b", "", "nothing", "https://h x/y"]
    df = spark.createDataFrame([(v,) for v in values], "u string")
    rows = df.select(urls.host(F.col("u")).alias("h"), urls.origin(F.col("u")).alias("o")).collect()
    for value, row in zip(values, rows):
        parsed = urlparse(value)
        assert row["h"] == parsed.netloc
        assert row["o"] == f"{parsed.scheme}://{parsed.netloc}"


def test_frame_join_and_normalize(spark):
    def frame(href, base):
        if href.startswith("http"):
            return href
        if href.startswith("/"):
            p = urlparse(base)
            return f"{p.scheme}://{p.netloc}{href}"
        return f"{base.rsplit('/', 1)[0]}/{href}"

    pairs = [(h, b) for h in HREFS for b in [*BASES, "https://f.example.com/e/list?u=a/b"]]
    df = spark.createDataFrame(pairs, "h string, b string")
    rows = df.select(urls.resolve_in_frame(F.col("h"), F.col("b")), urls.normalize(F.col("h"))).collect()
    assert [r[0] for r in rows] == [frame(h, b) for h, b in pairs]
    assert [r[1] for r in rows] == [h.split("?")[0].rstrip("/") for h, _ in pairs]
