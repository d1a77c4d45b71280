"""Pages to nested node rows, and the element table.

Building a tree from HTML is the one thing Spark cannot express, so it is the one Python stage:
a ``mapInArrow`` that turns each page into flat node columns. Pages are parsed where they lie,
without a shuffle, and output batches are bounded by node count however large the pages are.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.functions import nodes as N
from boardwalk.functions import tree
from boardwalk.schemas import NODES, TEXTS

# executors get the page helper with the job and need no installed package
cloudpickle.register_pickle_by_value(tree)


def spread(pages: DataFrame) -> DataFrame:
    """Repartition only when a scan has fewer splits than there are cores: a small input that
    lies in one file. Large inputs pass unchanged, so no HTML is shuffled. Meant for tables read
    from files; asking a plan with shuffles for its partitions would run them."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def shred(pages: DataFrame) -> DataFrame:
    """One nested row per page. Every column but ``html`` is kept; ``base_url`` is the URL
    links are resolved against. Store the result when several operators read it."""
    url = "frame_url" if "frame_url" in pages.columns else "url"
    kept = [f for f in pages.schema.fields if f.name not in ("html", url)]
    source = pages.select(*[f.name for f in kept], F.col(url).alias("base_url"), "html")
    schema = T.StructType([
        *kept,
        T.StructField("base_url", T.StringType()),
        T.StructField("texts", TEXTS),
        T.StructField("nodes", NODES),
    ])
    return source.mapInArrow(tree.shred_batches, schema)


def elements(shredded: DataFrame, *keys: str) -> DataFrame:
    """One row per element with its text."""
    names = keys or tuple(c for c in shredded.columns if c not in ("texts", "nodes"))
    return shredded.select(*names, "texts", F.explode("nodes").alias("n")).select(
        *names, "n.*", subtree_text(F.col("texts"), F.col("n")).alias("text")
    )


def subtree_text(texts: Column, node: Column) -> Column:
    """Stripped text nodes joined by one blank."""
    return N.subtree_text(texts, node)


def drop_chrome(elements_: DataFrame) -> DataFrame:
    """Without elements below nav, header or footer."""
    return elements_.filter(~F.col("in_chrome"))
