"""Titles and descriptions of containers, and the filters on titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import nodes as N
from boardwalk.functions.binding import let
from boardwalk.functions.fixed import (
    CELL_TAGS,
    DEFAULT_EXCLUDED_TITLES,
    FALLBACK_TITLE_CHARS,
    MIN_TITLE_LENGTH,
    MIN_TITLE_WORDS,
)
from boardwalk.functions.text import contains_any, hits_any, strip, word_count
from boardwalk.operators.containers import PageView
from boardwalk.operators.substrings import flag_literals


def default_title(page: PageView, c: Column, link: Column, named: Column) -> Column:
    """A heading is final even when empty; then link text, an element named like a title,
    and the first line of the container text."""
    first_line = strip(
        F.substring(F.substring_index(page.text(c), "\n", 1), 1, FALLBACK_TITLE_CHARS)
    )
    return let(
        page.first_heading(c),
        lambda head: F.when(head.isNotNull(), page.text(head)).otherwise(
            F.coalesce(
                F.nullif(page.text(link), F.lit("")),
                let(
                    N.first_descendant(named, c),
                    lambda hit: F.when(hit.isNotNull(), page.text(hit)),
                ),
                first_line,
            )
        ),
    )


def row_title(page: PageView, link: Column) -> Column:
    """Heading of the cell around the link, else link text, else cell text."""

    def in_cell(at: Column) -> Column:
        return let(
            F.get(page.nodes, at),
            lambda cell: let(
                page.first_heading(cell),
                lambda head: F.when(head.isNotNull(), page.text(head)).otherwise(
                    F.coalesce(F.nullif(page.text(link), F.lit("")), page.text(cell))
                ),
            ),
        )

    return let(
        N.nearest_ancestor(page.nodes, link, CELL_TAGS),
        lambda at: F.when(at.isNotNull(), in_cell(at)).otherwise(page.text(link)),
    )


def custom_title(page: PageView, c: Column, link: Column, titled: Column | None) -> Column:
    """Title rule, link text, heading; each step when the one before it is empty."""
    by_rule = F.lit("")
    if titled is not None:
        by_rule = let(
            N.first_descendant(titled, c),
            lambda hit: F.when(hit.isNotNull(), page.text(hit)).otherwise(F.lit("")),
        )
    heading = let(
        page.first_heading(c),
        lambda head: F.when(head.isNotNull(), page.text(head)).otherwise(F.lit("")),
    )
    return F.coalesce(
        F.nullif(by_rule, F.lit("")), F.nullif(page.text(link), F.lit("")), heading
    )


def rule_description(page: PageView, c: Column, described: Column) -> Column:
    """T4: text of the description rule, also when empty; without a hit the container text."""
    return let(
        N.first_descendant(described, c),
        lambda hit: F.when(hit.isNotNull(), page.text(hit)).otherwise(page.text(c)),
    )


def parent_text(page: PageView, link: Column) -> Column:
    """T4 for direct links: text of the parent; at the top level that is the document."""
    return F.when(link["parent"] < 0, F.array_join(page.texts, " ")).otherwise(
        page.text(F.get(page.nodes, link["parent"]))
    )


def long_enough(title: Column) -> Column:
    return F.length(title) >= MIN_TITLE_LENGTH


def valid_titles(postings: DataFrame) -> DataFrame:
    """T5: titles of at least three characters."""
    return postings.filter(long_enough(F.col("title")))


def multiword_titles(postings: DataFrame) -> DataFrame:
    """Titles of at least two words."""
    return postings.filter(word_count(F.col("title")) >= MIN_TITLE_WORDS)


def title_blocked(title: Column, words: list[str] | Column) -> Column:
    """A word occurs in the lower-cased title. The words are taken as they are, so one with
    capitals never hits; an empty word hits everything."""
    lowered = F.lower(title)
    if isinstance(words, Column):
        empty = F.coalesce(F.array_contains(words, ""), F.lit(False))
        return let(lowered, lambda t: empty | hits_any(t, words))
    return let(lowered, lambda t: contains_any(t, words))


def exclude_titles(
    postings: DataFrame, words: list[str] | str | DataFrame = DEFAULT_EXCLUDED_TITLES
) -> DataFrame:
    """T7 with a list, with the name of an array column of the board's own words, or, for lists of
    any length, with a table of them (``pattern``, with ``board_id`` where they hold for one board)."""
    if isinstance(words, DataFrame):
        by = ["board_id"] if "board_id" in words.columns else []
        flagged = flag_literals(postings, F.lower("title"), words, by=by, name="_blocked")
        return flagged.filter(~F.col("_blocked")).drop("_blocked")
    listed = F.col(words) if isinstance(words, str) else words
    return postings.filter(~title_blocked(F.col("title"), listed))
