"""Literal substrings from long lists: an index of short runs of bytes instead of a scan.

Every pattern is known by one run of up to ``runs.RUN`` of its bytes in UTF-8, its anchor. A text that
holds the pattern holds the anchor, so an equality join of the texts' runs with the anchors finds all
candidates, and a substring test keeps the right ones. Runs that are no anchor are left out where the
texts lie, by a set of fixed size, so few runs become rows. The cost of a text follows its length and
the patterns it nearly holds, not the length of the list.
"""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.functions import runs as R
from boardwalk.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, SAMPLED
from boardwalk.session import stored, tune

# executors get the helper with the job and need no installed package
cloudpickle.register_pickle_by_value(R)

# size of a set of runs as a power of two: bits for each run, up to 8 MB in all
LEAST_BITS, MOST_BITS, BITS_PER_RUN = 16, 26, 64
_GRAMS = T.StructField("_grams", T.ArrayType(T.LongType()))


def _with_grams(table: DataFrame, run) -> DataFrame:
    """The table through a Python stage that adds lists of runs; Arrow batches are bounded."""
    tune(table.sparkSession)
    return table.mapInArrow(run, T.StructType([*table.schema.fields, _GRAMS]))


def _run_set(grams: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A set of the runs in ``_grams``, of which there are ``count``, and its size as a power of two.
    What comes to the driver is the set, not the runs."""
    bits = min(max((BITS_PER_RUN * max(count, 1)).bit_length(), LEAST_BITS), MOST_BITS)
    rows = (grams.select("_grams").mapInArrow(lambda batches: R.set_words(batches, bits), "word long, held long")
            .groupBy("word").agg(F.bit_or("held").alias("held")).toPandas())
    words = np.zeros(1 << bits >> 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["held"].to_numpy(np.int64).view(np.uint64)
    return words, bits


def _held(texts: DataFrame, run_set: tuple[np.ndarray, int], sizes: list[int]) -> DataFrame:
    """Texts (``_text``) that hold runs of the set, with these in ``_grams``."""
    words, bits = run_set
    return _with_grams(texts, lambda batches: R.held_runs(batches, "_text", words, bits, sizes))


def _unbroadcast(table: DataFrame, small: bool) -> DataFrame:
    """Sizes the planner guesses for tables that were exploded are too small by far; only what was
    measured is broadcast."""
    return table if small else table.hint("merge")


def _anchored(texts: DataFrame, patterns: DataFrame, by: list[str], sizes: list[int], count: int, small: bool) -> DataFrame:
    """Patterns with their anchor: of their runs the one that fewest texts hold, and of these the one
    that fewest patterns share, so that candidates are few whatever the list is made of. Runs of
    patterns are counted in a sample of the texts; what it misses costs candidates, never hits."""
    own = stored(_with_grams(patterns, lambda batches: R.own_runs(batches, "pattern")))
    listed = own.withColumn("_gram", F.explode("_grams")).drop("_grams")
    sampled = _held(texts.select("_text").sample(SAMPLED, seed=1), _run_set(own, count), sizes)
    seen = sampled.select(F.explode("_grams").alias("_gram"), F.lit(1).alias("held"), F.lit(0).alias("shared")).unionByName(
        listed.select("_gram", F.lit(0).alias("held"), F.lit(1).alias("shared")))
    counts = seen.groupBy("_gram").agg(F.sum("held").alias("_held"), F.sum("shared").alias("_shared")).filter("_shared > 0")
    keys = [*by, "pattern"]
    carried = [c for c in patterns.columns if c not in keys]
    return (listed.join(_unbroadcast(counts, small), "_gram").groupBy(*keys)
            .agg(F.min_by("_gram", F.struct("_held", "_shared", "_gram")).alias("_gram"), *[F.first(c).alias(c) for c in carried]))


def _measured(patterns: DataFrame) -> tuple[list[int], int, int, bool]:
    """Lengths of runs the patterns need, how many patterns and runs there are, and whether a table of
    them may be broadcast."""
    size = F.least(F.octet_length("pattern"), F.lit(R.RUN))
    row_bytes = F.octet_length("pattern") * 2 + F.lit(32)
    shape = patterns.agg(
        F.sort_array(F.collect_set(size)).alias("sizes"), F.count("*").alias("rows"), F.sum(F.octet_length("pattern")).alias("runs"),
        F.sum(row_bytes * F.length("pattern")).alias("bytes"),
    ).first()
    fits = (shape["runs"] or 0) <= BROADCAST_ROWS and (shape["bytes"] or 0) <= BROADCAST_BYTES
    return list(shape["sizes"]), shape["rows"], shape["runs"] or 0, fits


def literal_hits(
    rows: DataFrame,
    text: Column,
    patterns: DataFrame,
    *,
    keys: list[str],
    by: list[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """One row (``keys``, columns of ``patterns``) per row and pattern its text contains, literally.

    ``patterns`` has ``pattern``, the ``by`` columns when patterns hold only for rows equal there, and
    columns that depend on these; repeated patterns count once, null and empty ones never hit. A
    table within the bounds of broadcasts is looked up where the texts lie, and no text is moved.
    Beyond them the runs are shuffled, and texts with candidates meet these by their digest; texts
    of equal SHA-256 count as equal.
    """
    by = by or []
    listed = patterns.filter(F.col("pattern") != "").dropDuplicates([*by, "pattern"])
    sizes, count, runs, fits = _measured(listed)
    small = fits if small is None else small
    out = list(dict.fromkeys([*keys, *by, *listed.columns]))
    texts = rows.select(*dict.fromkeys([*keys, *by]), text.alias("_text")).filter(F.col("_text").isNotNull())
    if not sizes:
        kinds = {f.name: f.dataType for f in listed.schema.fields}
        return texts.select(*[c if c in texts.columns else F.lit(None).cast(kinds[c]).alias(c) for c in out]).limit(0)
    anchors = stored(_anchored(texts, listed, by, sizes, runs, small))
    run_set = _run_set(anchors.select(F.array("_gram").alias("_grams")), count)
    found = F.contains("_text", F.col("pattern"))
    if small:
        near = _held(texts, run_set, sizes).withColumn("_gram", F.explode("_grams")).drop("_grams")
        return near.join(F.broadcast(anchors), [*by, "_gram"]).filter(found).select(*out)
    texts = texts.withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    held = _held(texts.select(*by, "_digest", "_text"), run_set, sizes)
    likely = held.select(*by, "_digest", F.explode("_grams").alias("_gram")).join(
        _unbroadcast(anchors, small), [*by, "_gram"]).drop("_gram").distinct()
    return texts.join(_unbroadcast(likely, small), [*by, "_digest"]).filter(found).select(*out)


def flag_literals(
    rows: DataFrame,
    text: Column,
    patterns: DataFrame,
    *,
    by: list[str] | None = None,
    name: str = "hit",
    small: bool | None = None,
) -> DataFrame:
    """Add ``name``: does the row's text contain any pattern? An empty pattern hits every text. Only
    digests of texts with a hit are brought back to the rows. No text is no hit."""
    by = by or []
    keyed = rows.withColumn("_text_key", F.unhex(F.sha2(text.cast("binary"), 256)))
    hits = literal_hits(keyed, text, patterns.select(*by, "pattern"), keys=["_text_key"], by=by, small=small)
    hits = hits.select(*by, "_text_key").distinct().withColumn("_hit", F.lit(True))
    empty = patterns.filter("pattern = ''")
    flagged = keyed.join(hits, [*by, "_text_key"], "left")
    if by:
        whole = empty.select(*by).distinct().withColumn("_whole", F.lit(True))
        flagged = flagged.join(whole, by, "left")
        whole_hit = F.col("_whole")
    else:
        whole_hit = empty.agg(F.count("*") > 0).scalar()
    hit = F.coalesce("_hit", whole_hit & text.isNotNull(), F.lit(False))
    return flagged.withColumn(name, hit).select(*rows.columns, name)
