"""New and previously seen matches, by URL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.nodes import attr


def _known(matches: DataFrame, history: DataFrame) -> DataFrame:
    """URLs of matches that the history has, each once.

    The matches' URLs are made distinct first, so one that very many matches share is a row per task
    before anything moves. The history is only asked; one stored in buckets by URL
    (``sources.tables.write_matches``) stays where it is.
    """
    asked = matches.select("url").filter(F.col("url").isNotNull()).distinct()
    return asked.join(history.select("url"), "url", "left_semi")


def _joined(matches: DataFrame, history: DataFrame, how: str, small: bool | None) -> DataFrame:
    if small:
        return matches.join(F.broadcast(history.select("url").distinct()), "url", how)
    # unique on url: what is broadcast, and which side is split for skew, is decided by sizes at run time
    return matches.join(_known(matches, history), "url", how)


def new_matches(matches: DataFrame, history: DataFrame, *, small: bool | None = None) -> DataFrame:
    """H1: URLs the history does not have. ``small`` says that the caller has measured the history and
    it may be broadcast."""
    return _joined(matches, history, "left_anti", small)


def seen_matches(matches: DataFrame, history: DataFrame, *, small: bool | None = None) -> DataFrame:
    """H2: URLs the history has."""
    return _joined(matches, history, "left_semi", small)


def with_section(matches: DataFrame, history: DataFrame, *, small: bool | None = None) -> DataFrame:
    """H1 and H2 in one pass: ``section`` is 'new' or 'seen'."""
    known = F.broadcast(history.select("url").distinct()) if small else _known(matches, history)
    rows = matches.join(known.withColumn("_known", F.lit(True)), "url", "left")
    return rows.withColumn(
        "section", F.when(F.col("_known"), F.lit("seen")).otherwise(F.lit("new"))
    ).drop("_known")


def history_from_report(shredded: DataFrame) -> DataFrame:
    """Distinct targets of the posting links in shredded report pages."""
    padded = F.concat(F.lit(" "), attr(F.col("n"), "class"), F.lit(" "))
    links = shredded.select(
        F.explode(F.filter("nodes", lambda n: n["tag"] == "a")).alias("n")
    ).filter(F.contains(padded, F.lit(" job-link ")))
    return links.select(attr(F.col("n"), "href").alias("url")).filter(F.col("url") != "").distinct()
