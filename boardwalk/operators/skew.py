"""Joins of large tables with lookup tables: broadcast behind a size check, salted beyond it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# heavy keys: share of the facts that is looked at, keys a sketch keeps, keys that are salted at most
SAMPLED = 0.1
TRACKED = 10_000
MOST_HEAVY = 1_000


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes a value takes in a row, about: content of texts, eight for each slot."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        total = F.aggregate(value, F.lit(16), lambda acc, x: acc + _bytes(x, kind.elementType).cast("int"))
        return F.coalesce(total, F.lit(8))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def row_bytes(table: DataFrame) -> Column:
    """About how many bytes a row of the table takes."""
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(8)).cast("long")


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """May this lookup table be broadcast? One aggregate measures it, from lengths alone."""
    shape = table.agg(F.count("*").alias("rows"), F.sum(row_bytes(table)).alias("bytes")).first()
    return shape["rows"] <= max_rows and (shape["bytes"] or 0) <= max_bytes


def heavy_keys(facts: DataFrame, on: list[str], tasks: int, sampled: float = SAMPLED) -> DataFrame | None:
    """(_key, _salts) of the keys that hold more than a task's even share of the facts, None when
    there are none. ``_key`` is the hash of the key columns.

    A frequent-items sketch over a sample finds them: one aggregate whose state does not grow with the
    number of keys. There are at most ``tasks`` of them, so the table may be broadcast. A key gets
    twice as many salts as its share fills tasks. What it misses costs balance, never rows.
    """
    keys = facts.select(F.xxhash64(*on).alias("_key")).sample(sampled, seed=1)
    top = min(max(tasks, 1), MOST_HEAVY)
    found = keys.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_key, {top}, {TRACKED})").alias("top")).first()
    rows = [(t["item"], math.ceil(2 * t["count"] * tasks / found["n"])) for t in found["top"] or []
            if t["item"] is not None and t["count"] * tasks > found["n"]]
    return facts.sparkSession.createDataFrame(rows, "_key long, _salts int") if rows else None


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    spread_by: list[str],
    small: bool | None = None,
) -> DataFrame:
    """Join facts with a lookup table whose keys may be very unevenly used.

    A lookup table within the measured bounds is broadcast and the facts do not move. With a larger
    one both sides shuffle on (key, salt): keys that hold much of the facts (``heavy_keys``) are
    spread over as many salts as their share asks for, and only their rows of the lookup table are
    copied; all others have one salt. ``spread_by`` names fact columns that vary within a key. The
    facts' keys are read once more for that, so facts should be stored. ``small`` skips the
    measurement of the lookup table when the caller has already made it.
    """
    if small is None:
        small = fits_broadcast(lookup)
    if small:
        return facts.join(F.broadcast(lookup), on, how)
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(facts, on, tasks, SAMPLED)
    if heavy is None:
        return facts.join(lookup, on, how)
    # names of its own, as callers' tables come with all sorts of columns
    near = F.broadcast(heavy.select(F.col("_key").alias("_heavy_key"), F.col("_salts").alias("_heavy_salts")))
    salts = F.coalesce(F.col("_heavy_salts"), F.lit(1))

    def marked(table: DataFrame, salt: Column) -> DataFrame:
        keyed = table.withColumn("_heavy_key", F.xxhash64(*on)).join(near, "_heavy_key", "left")
        return keyed.withColumn("_salt", salt).drop("_heavy_key", "_heavy_salts")

    salted = marked(facts, F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
    copies = marked(lookup, F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
