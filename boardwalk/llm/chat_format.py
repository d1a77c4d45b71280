"""Chat formatting by cumulative-snapshot collapse.

A log that stores a conversation after every turn holds it many times: each earlier state is a
prefix of a later one. Rolling hashes of the turns name every prefix; a conversation whose whole
hash is a proper prefix of another, or equals that of a conversation with a smaller id, is left out
by an anti-join. What remains is rendered.

The rolling hash of the turns up to ``turn`` is the exclusive or of position-labelled turn hashes,
twice with different seeds, with the number of turns. Unlike a chained hash it needs no order among
rows, so it is a running aggregate and a whole conversation's hash is a plain, partially aggregated
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("conv_id", "turn", "role", "text")
_KEY = ("n_turns", "hash_a", "hash_b")


def _turn_hash(seed: int) -> Column:
    """Of place, role and text; a flag next to each value tells null from empty."""
    parts = [F.lit(seed)]
    for name in ("turn", "role", "text"):
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def _turns(conversations: DataFrame) -> DataFrame:
    """Slim rows without texts; equal rows of a conversation count once."""
    slim = conversations.select("conv_id", "turn", _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"))
    return slim.distinct()


def maximal(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)``: the conversations that no other one repeats or continues.

    ``n_copies`` counts conversations equal to it, itself included. Turns are placed by ``turn``;
    turns with the same number count as one place, a null number comes first. Rows with a null
    ``conv_id`` form one conversation. Equal conversations keep the smallest id (null first).
    """
    slim = _turns(narrow(conversations))
    whole = slim.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bit_xor("h1").alias("hash_a"), F.bit_xor("h2").alias("hash_b"))
    unique = whole.groupBy(*_KEY).agg(
        F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"),
        F.count(F.lit(1)).alias("n_copies"))
    # one row per place, then the running hash of all places up to it
    placed = slim.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    so_far = (Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    prefixes = (placed.select(
        F.sum("n").over(so_far).alias("n_turns"), F.bit_xor("h1").over(so_far).alias("hash_a"),
        F.bit_xor("h2").over(so_far).alias("hash_b"), F.lead("n").over(later).alias("next"))
        .filter("next IS NOT NULL").select(*_KEY).distinct())
    return unique.join(prefixes, list(_KEY), "left_anti").select("conv_id", "n_turns", "n_copies")


def narrow(conversations: DataFrame) -> DataFrame:
    return conversations.select(*COLUMNS)


def render(conversations: DataFrame, kept: DataFrame, begin: str = "<|", end: str = "|>",
           stop: str = "<|end|>") -> DataFrame:
    """``kept`` with ``text``: turns in order, each as marker with role, line feed, text, stop mark.

    A null role is written as ``unknown``, a null text as empty. Turns with the same number are
    ordered by role and text. Roles and texts are written as they are: escape marks beforehand if
    the texts are not trusted.
    """
    turns = narrow(conversations).distinct().withColumnRenamed("conv_id", "of")
    keys = kept.select(F.col("conv_id").alias("of"))
    own = turns.join(keys, turns["of"].eqNullSafe(keys["of"]), "left_semi")
    piece = F.concat(F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit(end + "\n"),
                     F.coalesce("text", F.lit("")), F.lit(stop))
    order = F.struct(F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role",
                     F.col("text").isNotNull().alias("c"), "text", piece.alias("piece"))
    texts = own.groupBy("of").agg(F.sort_array(F.collect_list(order)).alias("all")).select(
        "of", F.array_join(F.col("all.piece"), "\n").alias("text"))
    return kept.join(texts, kept["conv_id"].eqNullSafe(texts["of"])).drop("of")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: ``conv_id, n_turns, n_copies, text``."""
    return render(conversations, maximal(conversations))
