"""Table schemas, and the columns that identify a page row throughout."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),         # preorder number = index in the array
    T.StructField("last", T.IntegerType()),        # preorder number of the last descendant
    T.StructField("parent", T.IntegerType()),      # -1 at the root
    T.StructField("depth", T.IntegerType()),       # number of ancestors
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("in_chrome", T.BooleanType()),   # an ancestor is nav, header or footer
    T.StructField("last_child", T.BooleanType()),
    T.StructField("t_lo", T.IntegerType()),        # slice of texts under the node
    T.StructField("t_hi", T.IntegerType()),
])
NODES = T.ArrayType(NODE)
TEXTS = T.ArrayType(T.StringType())

RULE = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id_eq", T.StringType()),
    T.StructField("class_eq", T.StringType()),     # blank-separated, all required
    T.StructField("attr", T.StringType()),         # the first attribute test; others in more
    T.StructField("op", T.StringType()),           # exists = *= ^= $=
    T.StructField("value", T.StringType()),
    T.StructField("ci", T.BooleanType()),
    T.StructField("ancestor_tag", T.StringType()),
    T.StructField("ancestor_class", T.StringType()),
    T.StructField("ancestor_attr", T.StringType()),
    T.StructField("ancestor_op", T.StringType()),
    T.StructField("ancestor_value", T.StringType()),
    T.StructField("last_child", T.BooleanType()),
    T.StructField("has_text", T.StringType()),
    T.StructField("more", T.ArrayType(T.StructType([
        T.StructField("attr", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    T.StructField("child", T.BooleanType()),       # the ancestor is the parent
    T.StructField("first_child", T.BooleanType()),
])
# rule_set: container, link, title, description or pagination; board_id null = every board
SELECTOR_RULES = T.StructType([
    T.StructField("rule_set", T.StringType()),
    T.StructField("board_id", T.LongType()),
    *RULE.fields,
])

LOCATION = T.StructType([
    T.StructField("include", T.ArrayType(T.StringType())),
    T.StructField("exclude", T.ArrayType(T.StringType())),
])
BOARDS = T.StructType([
    T.StructField("board_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("job_board_url", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("location_filters", LOCATION),
    T.StructField("use_iframe", T.BooleanType()),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("has_scraping_config", T.BooleanType()),
    T.StructField("use_js_navigation", T.BooleanType()),
    T.StructField("exclude_urls", T.ArrayType(T.StringType())),
    T.StructField("exclude_titles", T.ArrayType(T.StringType())),
    # null = default rules, empty = no pagination, list = only those
    T.StructField("pagination_selectors", T.ArrayType(T.StringType())),
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("board_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
FRAMES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("board_id", T.LongType()),
    T.StructField("frame_no", T.IntegerType()),
    T.StructField("frame_url", T.StringType()),
    T.StructField("html", T.StringType()),
])
NAVIGATIONS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("board_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("initial_url", T.StringType()),
    T.StructField("title_text", T.StringType()),
    T.StructField("container_text", T.StringType()),
    T.StructField("landed_url", T.StringType()),
])
POSTINGS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("board_id", T.LongType()),
    T.StructField("seq", T.LongType()),            # order within the page, not dense
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
])
