"""A training corpus from raw documents, as stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epochgraph.llm import language, near, packing, quality
from epochgraph.llm.common import checkpointed
from epochgraph.llm.queries import WORDS, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with enough confidence."""
    return language.accepted(docs)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality isn't rejected; the labels are the table's own."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def thin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    return near.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the token sequences."""
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("quality_classifier", judge),
    ("simhash_near_dedup", thin),
    ("best_fit_packing", pack),
]

#: Trained models and a vocabulary decide every row; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a filter keeps is checkpointed, as the next stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
