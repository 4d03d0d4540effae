"""Corpus pipeline: good, civil, distinct, uncontaminated documents, packed into sequences.

Each stage works on all that the stage before kept; all but the last return the columns of
``documents``. Models are trained at their stage from the labels of documents that reach it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import decontamination, near_dedup, packing, quality_model, toxicity
from turnwise.llm.common import documents, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_model.good_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def civility(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.civil_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark passages by the contamination rule."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Best-fit packing of what is left; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("toxicity", civility),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: Trained models, near-duplicate classes and tokenisation have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages in turn over ``documents``; what a stage returns is written and read again."""
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
