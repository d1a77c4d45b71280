"""K1-K6: board and keyword tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.text import strip


def select_boards(boards: DataFrame, name: str) -> DataFrame:
    """K1: every board of that name, whatever the case. An unknown name is an error that says
    which names there are."""
    chosen = boards.filter(F.lower("name") == name.lower())
    if chosen.isEmpty():
        # names come from configurations, not from crawled data
        names = [r["name"] for r in boards.select("name").distinct().orderBy("name").collect()]
        raise ValueError(f"board {name!r} not found; available: {', '.join(map(str, names))}")
    return chosen


def keyword_array(universal: Column, own: Column) -> Column:
    """Lower-cased union of the universal and a board's own keywords."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(universal, none), F.coalesce(own, none))
    return F.array_distinct(F.transform(F.filter(both, lambda k: k.isNotNull()), F.lower))


def board_keywords(boards: DataFrame, universal: Column) -> DataFrame:
    """K2: (board_id, keyword), distinct. ``universal`` is an array expression: the list is one
    value of the configuration, so it needs no join."""
    return boards.select(
        "board_id", F.explode(keyword_array(universal, F.col("keywords"))).alias("keyword")
    )


def clean_keyword_lists(table: DataFrame, column: str) -> DataFrame:
    """K3: comma-separated lists to one trimmed, non-empty keyword per row, repeats kept."""
    keys = [c for c in table.columns if c != column]
    return table.select(*keys, F.posexplode(F.split(column, ",", -1)).alias("pos", "k")).select(
        *keys, "pos", strip(F.col("k")).alias("keyword")
    ).filter(F.col("keyword") != "")


def merge_universal(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K4: append keywords not there yet; the comparison is case-sensitive. Both tables are
    (pos, keyword); ``pos`` of the result orders existing before new keywords."""
    both = existing.select(F.lit(0).alias("part"), "pos", "keyword").unionByName(
        new.select(F.lit(1).alias("part"), "pos", "keyword")
    )
    return both.groupBy("keyword").agg(F.min(F.struct("part", "pos")).alias("first")).select(
        "keyword", F.col("first.part").alias("part"), F.col("first.pos").alias("pos")
    )


def append_boards(boards: DataFrame, new: DataFrame) -> DataFrame:
    """K5: append without removing equal names or URLs."""
    return boards.unionByName(new, allowMissingColumns=True)


def scrapable_boards(boards: DataFrame) -> DataFrame:
    """K6: boards that have a URL."""
    return boards.filter(F.coalesce("job_board_url", F.lit("")) != "")
