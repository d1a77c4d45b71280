"""Choosing posting containers inside the page row.

Everything here is an expression over the arrays of one page, so no page content is shuffled and
no pairs of elements are formed. A container keeps its place in the default order as ``code``:
(tag, keyword, attribute) for C1, then the result items of C2, table rows (C3) and direct links.
A node that several rules select appears once, with its least code; later appearances never win.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from boardwalk.functions import nodes as N
from boardwalk.functions import urls
from boardwalk.functions.fixed import (
    CONTAINER_ATTRS,
    CONTAINER_TAGS,
    CONTAINER_WORDS,
    FRAME_CONTAINER_RULES,
    FRAME_JOB_WORDS,
    HEADING_TAGS,
    JOB_LINK_PATTERNS,
    MIN_ROW_TEXT,
    NAMED_TITLE_TAGS,
    NAMED_TITLE_WORDS,
    RESULT_ITEM_EXCLUDED,
    RESULT_ITEM_RULES,
    RULE_FIELDS,
)
from boardwalk.functions.binding import built_once, let
from boardwalk.functions.text import contains_any, first_hit, word_list
from boardwalk.operators.skew import lookup_join
from boardwalk.schemas import RULE

_PER_TAG = len(CONTAINER_WORDS) * len(CONTAINER_ATTRS)
RESULT_ITEM_CODE = len(CONTAINER_TAGS) * _PER_TAG
ROW_CODE = RESULT_ITEM_CODE + len(RESULT_ITEM_RULES)
DIRECT_LINK_CODE = ROW_CODE + 1


@dataclass(frozen=True)
class PageView:
    """Columns of one page row inside an expression; the lookups are evaluated once per page."""

    nodes: Column
    texts: Column
    base_url: Column
    links: Column
    heads: Column

    def text(self, node: Column) -> Column:
        return N.subtree_text(self.texts, node)

    def first_link(self, node: Column) -> Column:
        """First ``a[href]`` below a container; an empty href is not skipped."""
        return N.first_descendant(self.links, node)

    def first_heading(self, node: Column) -> Column:
        return N.first_descendant(self.heads, node)


def span(n: Column, *more: Column) -> Column:
    """A node reduced to its place in the page."""
    return F.struct(
        *[n[f].alias(f) for f in ("pre", "last", "parent", "depth", "tag", "t_lo", "t_hi")], *more
    )


def link_nodes(nodes: Column) -> Column:
    return F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "a") & N.attr(n, "href").isNotNull()),
        lambda a: span(a, a["in_chrome"].alias("in_chrome"), N.attr(a, "href").alias("href")),
    )


def heading_nodes(nodes: Column) -> Column:
    return N.pick(nodes, lambda n: n["tag"].isin(*HEADING_TAGS), "pre", "t_lo", "t_hi")


def named_nodes(nodes: Column) -> Column:
    """span, div and p whose class mentions a title or a name."""
    return N.pick(
        nodes,
        lambda n: n["tag"].isin(*NAMED_TITLE_TAGS)
        & F.coalesce(contains_any(F.lower(N.attr(n, "class")), NAMED_TITLE_WORDS), F.lit(False)),
        "pre", "t_lo", "t_hi",
    )


def per_page(body: Callable[[PageView], Column]) -> Column:
    """An expression over a page row with its link and heading lookups in reach."""
    nodes, texts, base = F.col("nodes"), F.col("texts"), F.col("base_url")
    return let(
        N.lookup(link_nodes(nodes)),
        lambda links: let(
            N.lookup(heading_nodes(nodes)),
            lambda heads: body(PageView(nodes, texts, base, links, heads)),
        ),
    )


def page_columns(shredded: DataFrame) -> list[str]:
    """Columns that identify a page row."""
    return [c for c in shredded.columns if c not in ("texts", "nodes")]


def default_candidates(page: PageView, items_only: bool = False) -> Column:
    """C1, C2 and C3 with chrome removed (E3), then direct links: spans with a ``code``, the least
    where several kinds fit. ``items_only``: the code as a result item, whatever else fits."""
    item_rules = rules_literal(RESULT_ITEM_RULES)

    def word_code(n: Column) -> Column:
        """(tag, keyword, attribute) of the first keyword any of the attributes holds."""
        values = F.transform(word_list(CONTAINER_ATTRS), lambda a: N.attr(n, a))
        words = word_list(CONTAINER_WORDS)
        tags = word_list(CONTAINER_TAGS)
        return let(
            values,
            lambda v: let(
                F.get(F.filter(words, lambda w: F.contains(F.concat_ws("\n", v), w)), F.lit(0)),
                lambda word: (F.array_position(tags, n["tag"]) - 1) * _PER_TAG
                + (F.array_position(words, word) - 1) * len(CONTAINER_ATTRS)
                + F.array_position(
                    F.transform(v, lambda x: F.coalesce(F.contains(x, word), F.lit(False))), True
                )
                - 1,
            ),
        )

    def item_code(n: Column) -> Column:
        qa = N.attr(n, "data-qa")
        hits = F.filter(item_rules, lambda r: N.node_matches(n, r))
        return F.when(
            qa.isNotNull() & ~contains_any(F.lower(qa), RESULT_ITEM_EXCLUDED),
            F.get(hits, F.lit(0))["rank"] + RESULT_ITEM_CODE,
        )

    def row_code(n: Column, row_links: Column) -> Column:
        return F.when(
            N.has_ancestor_tag(page.nodes, n, "table")
            & N.first_descendant(row_links, n).isNotNull()
            & (F.length(page.text(n)) > MIN_ROW_TEXT),
            F.lit(ROW_CODE),
        )

    def code(n: Column, row_links: Column) -> Column:
        return (
            F.when(n["in_chrome"], F.lit(None))
            .when(n["tag"] == "tr", row_code(n, row_links))
            .when(n["tag"].isin(*CONTAINER_TAGS), item_code(n) if items_only else F.coalesce(word_code(n), item_code(n)))
        )

    def containers(row_links: Column) -> Column:
        places = F.filter(page.nodes, lambda n: n["tag"].isin(*CONTAINER_TAGS, "tr"))
        return F.transform(places, lambda n: span(n, code(n, row_links).cast("int").alias("code")))

    usable = F.filter(
        page.links["items"],
        lambda a: F.startswith(a["href"], F.lit("http")) | F.startswith(a["href"], F.lit("/")),
    )
    direct = F.transform(
        F.filter(page.links["items"], lambda a: ~a["in_chrome"]),
        lambda a: span(a, (F.lit(DIRECT_LINK_CODE) + first_hit(a["href"], JOB_LINK_PATTERNS)).alias("code")),
    )
    return F.filter(
        F.concat(let(N.lookup(usable), containers), direct), lambda c: c["code"].isNotNull()
    )


def is_direct(c: Column) -> Column:
    return c["code"] >= DIRECT_LINK_CODE


def with_links(page: PageView, candidates: Column) -> Column:
    """Add the link of each candidate and its absolute URL; candidates without one go away. The
    link of a direct candidate is the candidate."""

    def own_link(c: Column) -> Column:
        return F.get(
            page.links["items"],
            F.when(c["pre"] == 0, F.lit(0)).otherwise(F.get(page.links["at"], c["pre"] - 1)),
        )

    linked = F.transform(
        candidates,
        lambda c: let(
            F.when(is_direct(c), own_link(c)).otherwise(page.first_link(c)),
            lambda link: F.struct(
                c.alias("c"), link.alias("link"),
                urls.resolve(link["href"], page.base_url).alias("url"),
            ),
        ),
    )
    return F.filter(linked, lambda x: F.coalesce(x["url"] != "", F.lit(False)))


@built_once
def _default_kind(low: int, high: int) -> Column:
    return per_page(
        lambda page: F.transform(
            F.filter(
                default_candidates(page, items_only=low == RESULT_ITEM_CODE), lambda c: (c["code"] >= low) & (c["code"] < high)
            ),
            lambda c: F.struct(
                c["code"].alias("code"), c["tag"].alias("tag"), c["pre"].alias("pre"),
                c["last"].alias("last"), page.text(c).alias("text"),
                page.first_link(c)["href"].alias("href"),
            ),
        )
    )


def _containers(shredded: DataFrame, low: int, high: int) -> DataFrame:
    return shredded.select(*page_columns(shredded), F.inline(_default_kind(low, high)))


def keyword_containers(shredded: DataFrame) -> DataFrame:
    """Article, li and div whose class, id, data-qa or data-testid holds a keyword."""
    return _containers(shredded, 0, RESULT_ITEM_CODE)


def result_item_containers(shredded: DataFrame) -> DataFrame:
    """Data-qa result items that are not talent-community or event cards, those that a keyword
    selects as well included."""
    return _containers(shredded, RESULT_ITEM_CODE, ROW_CODE)


def row_containers(shredded: DataFrame) -> DataFrame:
    """Table rows with a usable link and enough text."""
    return _containers(shredded, ROW_CODE, DIRECT_LINK_CODE)


def rules_literal(rows: list[dict]) -> Column:
    """Rule rows known when the plan is built, as one constant."""
    return F.from_json(F.lit(json.dumps(rows)), ArrayType(RULE))


def attach_rules(
    shredded: DataFrame,
    rules: DataFrame | None,
    *rule_sets: str,
    settings: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Put a board's rules into its page rows: one rank-ordered array ``_<rule set>`` each, next
    to the columns of ``settings`` (one row per board).

    Rules without a board hold for boards that have none of their own. Rules and settings are
    brought together per board first and joined to whole page rows once, so page content moves
    at most once, and not at all when the lookup table can be broadcast.
    """

    def packed(rule_set: str) -> Column:
        # tables written before a field was added do without it
        row = F.struct(*[(F.col(f.name) if f.name in rules.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                         for f in RULE.fields])
        return F.array_sort(F.collect_list(F.when(F.col("rule_set") == rule_set, row)))

    lookup, shared = settings, None
    if rules is not None:
        mine = rules.filter(F.col("rule_set").isin(*rule_sets))
        lookup = mine.filter(F.col("board_id").isNotNull()).groupBy("board_id").agg(
            *[packed(s).alias(f"_{s}") for s in rule_sets]
        )
        shared = mine.filter(F.col("board_id").isNull())
        if settings is not None:
            lookup = settings.join(lookup, "board_id", "full")
    joined = lookup_join(shredded, lookup, ["board_id"], "left", spread_by=["page_id"], small=small)
    if shared is None:
        return joined
    return joined.withColumns({
        f"_{s}": F.when(F.size(f"_{s}") > 0, F.col(f"_{s}")).otherwise(
            shared.agg(packed(s).alias("r")).scalar()
        )
        for s in rule_sets
    })


def matched_nodes(
    nodes: Column, texts: Column, rules: Column, among: Column | None = None
) -> Column:
    """Nodes selected by at least one rule, with all their ranks; in document order."""
    ranked = F.transform(
        nodes if among is None else among,
        lambda n: span(
            n, n["in_chrome"].alias("in_chrome"), N.attr(n, "href").alias("href"),
            F.transform(
                F.filter(rules, lambda r: N.rule_matches(nodes, texts, n, r)), lambda r: r["rank"]
            ).alias("ranks"),
        ),
    )
    return F.when(
        F.size(rules) > 0, F.filter(ranked, lambda n: F.size(n["ranks"]) > 0)
    ).otherwise(F.filter(ranked, lambda n: F.lit(False)))


def matched_by_set(nodes: Column, texts: Column, **rule_sets: Column) -> Column:
    """Nodes selected by any rule of several sets, found in one pass over the page; ``hits``
    holds the (rule_set, rank) pairs of each node."""
    def tagged(name: str, rules: Column) -> Column:
        return F.transform(
            rules,
            lambda r: F.struct(
                F.lit(name).alias("rule_set"), *[r[f].alias(f) for f in RULE_FIELDS]
            ),
        )

    def found(rules: Column) -> Column:
        ranked = F.transform(
            nodes,
            lambda n: span(
                n, n["in_chrome"].alias("in_chrome"), N.attr(n, "href").alias("href"),
                F.filter(rules, lambda r: N.rule_matches(nodes, texts, n, r)).alias("hits"),
            ),
        )
        return F.filter(ranked, lambda n: F.size(n["hits"]) > 0)

    return let(F.concat(*[tagged(name, rules) for name, rules in rule_sets.items()]), found)


def of_set(found: Column, rule_set: str) -> Column:
    """The nodes of ``matched_by_set`` that one rule set selects, with their ranks in it."""

    def ranks(n: Column) -> Column:
        mine = F.filter(n["hits"], lambda h: h["rule_set"] == rule_set)
        return F.transform(mine, lambda h: h["rank"])

    placed = F.transform(
        found,
        lambda n: span(
            n, n["in_chrome"].alias("in_chrome"), n["href"].alias("href"), ranks(n).alias("ranks")
        ),
    )
    return F.filter(placed, lambda n: F.size(n["ranks"]) > 0)


def select_elements(
    shredded: DataFrame, rules: DataFrame | list[dict], rule_set: str = "container"
) -> DataFrame:
    """Elements selected by rules, one row per (rank, element). Order is (rank, pre)."""
    keys = page_columns(shredded)
    if isinstance(rules, list):
        pages = shredded.withColumn("_rules", rules_literal(rules))
    else:
        pages = attach_rules(shredded, rules, rule_set).withColumnRenamed(f"_{rule_set}", "_rules")
    found = matched_nodes(F.col("nodes"), F.col("texts"), F.col("_rules"))
    return pages.select(*keys, "texts", F.explode(found).alias("c")).select(
        *keys, F.explode(F.array_distinct("c.ranks")).alias("rank"),
        F.col("c.pre").alias("pre"), F.col("c.last").alias("last"), F.col("c.tag").alias("tag"),
        F.col("c.href").alias("href"), N.subtree_text(F.col("texts"), F.col("c")).alias("text"),
    )


def winning_rank(found: Column) -> Column:
    """C4: nodes of the first rule that selects anything; the chrome filter comes afterwards."""
    return let(
        F.array_min(F.transform(found, lambda n: F.array_min(n["ranks"]))),
        lambda best: F.filter(found, lambda n: F.array_contains(n["ranks"], best) & ~n["in_chrome"]),
    )


def _slim(shredded: DataFrame, found: Column) -> DataFrame:
    keys = page_columns(shredded)
    keys = [k for k in keys if not k.startswith("_")]
    return shredded.select(*keys, "texts", F.explode(found).alias("c")).select(
        *keys, F.array_min("c.ranks").alias("rank"), F.col("c.pre").alias("pre"),
        F.col("c.last").alias("last"), N.subtree_text(F.col("texts"), F.col("c")).alias("text"),
    )


def first_matching_rule(shredded: DataFrame, rules: DataFrame) -> DataFrame:
    """C4 as a table: the containers of each page under its board's container rules."""
    pages = attach_rules(shredded, rules, "container")
    found = matched_nodes(F.col("nodes"), F.col("texts"), F.col("_container"))
    return _slim(pages, let(found, winning_rank))


def frame_containers(shredded: DataFrame) -> DataFrame:
    """Containers inside frame documents, each once, chrome included."""
    rules = rules_literal(FRAME_CONTAINER_RULES)
    return _slim(shredded, matched_nodes(F.col("nodes"), F.col("texts"), rules))


def job_frames(shredded: DataFrame) -> DataFrame:
    """Documents whose text mentions jobs at all."""
    return shredded.filter(
        F.exists("texts", lambda t: F.lower(t).rlike("|".join(FRAME_JOB_WORDS)))
    )
