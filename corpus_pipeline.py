"""The corpus pipeline: toxicity, quality rules, line dedup, near-duplicates, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last packs
what is left. Line dedup comes before near-dedup, so a copy may lose all its lines there: documents
that lost lines and are left with fewer words than the base rules ask for go with them. A document
that lost none stays, whatever its length. ``run`` writes every stage as Parquet in the shared folder and reads it again, so a
lost executor costs no finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boardwalk.llm import line_dedup, near_dup, packing, quality, toxicity
from boardwalk.llm.common import table
from boardwalk.session import stored, tune


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs, least_words=quality.MIN_WORDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("line_dedup", drop_repeated_lines),
          ("minhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
