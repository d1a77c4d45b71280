"""What went wrong with single boards: a table next to the results instead of a run that stops.

A row is (board_id, step, reason, stops). A board with a row that ``stops`` contributes nothing to a
run and keeps its zeros in the funnel; other rows tell of a part that was left out, such as a selector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["board_id", "step", "reason", "stops"]
SCHEMA = "board_id long, step string, reason string, stops boolean"


def failure_rows(
    rows: DataFrame, step: str, reason: Column, *, stops: bool, keys: list[str] | None = None
) -> DataFrame:
    """``keys`` are columns that go in front, where a board's number says too little."""
    return rows.select(*(keys or []), "board_id", F.lit(step).alias("step"), reason.alias("reason"), F.lit(stops).alias("stops"))


def all_failures(*tables: DataFrame) -> DataFrame:
    """The rows of several tables, each once."""
    first, *others = tables
    for table in others:
        first = first.select(*COLUMNS).unionByName(table.select(*COLUMNS))
    return first.distinct()


def route_failures(boards: DataFrame, flows: list[str]) -> DataFrame:
    """Boards whose ``route`` names a flow that there is not."""
    if "route" not in boards.columns:
        boards = boards.withColumn("route", F.lit(None).cast("string"))
    unknown = boards.filter(F.col("route").isNotNull() & ~F.col("route").isin(flows))
    return failure_rows(unknown, "route", F.concat(F.lit("no flow is named "), F.col("route")), stops=True)


def flow_failures(
    boards: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], pages: DataFrame, columns: list[str]
) -> tuple[DataFrame | None, dict[str, Callable[[DataFrame], DataFrame]]]:
    """Try out added flows on a plan: those that cannot be planned, or lack a column of postings, fail
    the boards that take them, and only these. Returns their rows and the flows that are left. What
    goes wrong in rows, while a flow runs, still fails the job."""
    rows, sound = None, {}
    for name, flow in extractors.items():
        try:
            flow(pages).select(*columns)
            sound[name] = flow
        except Exception as error:  # noqa: BLE001 - any error of foreign code is a reason
            reason = F.lit(f"flow {name}: {type(error).__name__}")
            one = failure_rows(boards.filter(F.col("route") == name), "route", reason, stops=True)
            rows = one if rows is None else rows.unionByName(one)
    return rows, sound


def stopped(failures: DataFrame) -> DataFrame:
    """Ids of boards that contribute nothing."""
    return failures.filter("stops").select("board_id").distinct()
