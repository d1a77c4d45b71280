from pyspark.sql import functions as F

from boardwalk.functions import tree
from boardwalk.operators.shredding import drop_chrome, elements
from helpers import pages, shredded


def shape(spark, html):
    rows = elements(shredded(spark, html)).orderBy("pre").collect()
    return [(r["tag"], r["parent"], r["last"], r["text"]) for r in rows]


def test_unclosed_and_unmatched_tags(spark):
    assert shape(spark, "<div><p>a<p>b</span></div>c") == [
        ("div", -1, 2, "a b"), ("p", 0, 2, "a b"), ("p", 1, 2, "b"),
    ]


def test_void_self_closing_and_silent(spark):
    html = "<p>x<br>y<br/>z</br><i/>w</p><script>var t='<b>no</b>'</script><style>p{}</style>"
    assert shape(spark, html) == [
        ("p", -1, 3, "x y z w"), ("br", 0, 1, ""), ("br", 0, 2, ""), ("i", 0, 3, ""),
        ("script", -1, 4, ""), ("style", -1, 5, ""),
    ]


def test_comment_splits_text_and_entities_are_decoded(spark):
    assert shape(spark, "<p>a<!-- x -->b &amp; &eacute;<b> c </b></p>")[0][3] == "a b & é c"


def test_attributes(spark):
    html = '<a HREF="/x?a=1&amp;b=2" class=" one\n two " data-x>t</a><a href=/y href=/z>u</a>'
    rows = elements(shredded(spark, html)).orderBy("pre").collect()
    assert rows[0]["attrs"] == {"href": "/x?a=1&b=2", "class": "one two", "data-x": ""}
    assert rows[1]["attrs"] == {"href": "/z"}


def test_chrome_is_about_ancestors(spark):
    rows = elements(shredded(spark, "<nav><p>a</p></nav><footer></footer><p>b</p>"))
    assert [r["tag"] for r in drop_chrome(rows).orderBy("pre").collect()] == ["nav", "footer", "p"]


def test_last_child_depth_and_empty_pages(spark):
    rows = elements(shredded(spark, "<ul><li>a</li><li>b</li></ul>")).orderBy("pre").collect()
    assert [(r["tag"], r["last_child"], r["depth"]) for r in rows] == [
        ("ul", True, 0), ("li", False, 1), ("li", True, 1),
    ]
    sizes = shredded(spark, "", None, "text only").select(F.size("nodes"), "texts").collect()
    assert [tuple(r) for r in sizes] == [(0, []), (0, []), (0, ["text only"])]


def test_partitioning_and_batches_change_nothing(spark, monkeypatch):
    htmls = [f"<div id='d{i}'>{'<p>x</p>' * (i % 7)}</div>" for i in range(200)]
    plain = pages(spark, *htmls)
    from boardwalk.operators.shredding import shred

    one = sorted(map(str, shred(plain.coalesce(1)).collect()))
    many = sorted(map(str, shred(plain.repartition(7)).collect()))
    assert one == many and len(one) == 200
    assert tree.NODES_PER_BATCH > 0
