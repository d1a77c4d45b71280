import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardwalk.functions.text import first_hit, mark_edges, mark_keyword, strip, word_count, word_tokens

TEXT = st.text(alphabet="ab1_é́ß+.- \n,", max_size=14)
WORD = st.text(alphabet="ab1_é́+. ", max_size=5)


def python_hit(text, keyword):
    return bool(re.search(r"\b" + re.escape(keyword) + r"\b", text))


def spark_hits(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, k string")
    hit = F.contains(mark_edges(F.col("t")), mark_keyword(F.col("k")))
    return [r[0] for r in df.select(hit.alias("h")).collect()]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, WORD), min_size=40, max_size=80))
def test_word_edges_agree_with_python(spark, pairs):
    assert spark_hits(spark, pairs) == [python_hit(t, k) for t, k in pairs]


def test_word_edge_cases(spark):
    pairs = [
        ("senior golang developer", "go"), ("go developer", "go"), ("c++ dev", "c++"),
        ("c++dev", "c++"), ("", ""), ("- -", ""), ("a", ""), ("café bar", "cafe"),
        ("été", "t"), ("a.net b", ".net"), (".net b", ".net"), ("one two  three", "two three"),
        ("one two three", "two three"), ("x_y", "x"),
    ]
    assert spark_hits(spark, pairs) == [python_hit(t, k) for t, k in pairs]


def test_strip_and_counts(spark):
    texts = ["  a b ", "\x1c x \x85", "", " \t\n", "a　b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n")).collect()
    assert [r["s"] for r in rows] == [t.strip() for t in texts]
    assert [r["n"] for r in rows] == [len(t.split()) for t in texts]


def test_tokens_and_first_hit(spark):
    df = spark.createDataFrame([("a-b a_b é1 a",)], "t string")
    row = df.select(
        word_tokens(F.col("t")).alias("w"), first_hit(F.col("t"), ["zz", "_b", "a"]).alias("i"),
        first_hit(F.col("t"), ["zz"]).alias("none"),
    ).first()
    assert row["w"] == ["a", "b", "a_b", "é1"] and row["i"] == 1 and row["none"] is None
