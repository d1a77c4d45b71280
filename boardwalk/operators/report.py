"""Report tables. No group is ever collected: a company may hold most of all matches.

Input: matches with ``section`` ('new' or 'seen'), company, board_id, page_no and seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def report_groups(matches: DataFrame, *, by_section: bool = True) -> DataFrame:
    """Jobs per company, sections one after the other, companies by code point. The jobs of
    a group are the rows of ``report_rows`` with the same section and company."""
    keys = ["section", "company"] if by_section else ["company"]
    return matches.groupBy(*keys).agg(F.count("*").alias("n_jobs")).orderBy(*keys)


def report_totals(matches: DataFrame) -> DataFrame:
    """R2: one row with the number of matches, new ones, seen ones and companies."""
    return matches.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("section") == "new").alias("new"),
        F.count_if(F.col("section") == "seen").alias("seen"),
        F.count_distinct("company").alias("companies"),
    )


def report_rows(matches: DataFrame) -> DataFrame:
    """Flat report rows, new before seen, in match order within a company. The sort key ends
    in the position of the match, so range partitioning also splits a company with most rows."""
    return matches.orderBy("section", "company", "board_id", "page_no", "seq", "url").select(
        "section", "company", "title", "url",
        F.array_join("matched_keywords", ", ").alias("keywords"),
    )
