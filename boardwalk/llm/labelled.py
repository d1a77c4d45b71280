"""Labelled rows for fitting: all of them, one for each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.operators.skew import lookup_join


def known(labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """``(doc_id, label)`` of every labelled document, one row for each id.

    Rows with a null id or label are no labels. If an id has several labels, the largest counts.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        own = own.filter(where)
    return own.groupBy("doc_id").agg(F.max("label").alias("label"))


def with_label(documents: DataFrame, labelled: DataFrame, how: str = "left") -> DataFrame:
    """Documents with ``label``, null where there is none (``how``: inner leaves those out). Labels
    that are measured small are broadcast; with more of them the documents move once."""
    others = [c for c in documents.columns if c != "doc_id"]
    return lookup_join(documents, labelled, ["doc_id"], how, spread_by=others)
