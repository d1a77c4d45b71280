"""Binding a value inside an expression."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it any number of times in ``body``, also inside lambdas.

    A column of a child projection gives no such guarantee: the optimizer merges projections
    when a column is referenced once, and one reference inside a lambda is one evaluation per
    array element. It also keeps expression trees small where a value is used many times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(table: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters read them. A filter on a plain column is pushed
    below the projection that computes it and evaluates it a second time; it cannot be pushed
    below a generator."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return table.select("*", F.explode(F.array(row)).alias("_pinned")).select(
        *table.columns, "_pinned.*"
    )


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a large expression for the next call with the same arguments in this application.

    An expression is only a description, so the same one can go into any number of plans, while
    building one costs a round trip to the JVM per operation.
    """
    kept: dict[tuple, Column] = {}

    @functools.wraps(make)
    def cached(*args) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return cached
