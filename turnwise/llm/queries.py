"""Registered queries of the text operators over the given tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import (
    byte_bpe,
    centroids,
    decontamination,
    fill_middle,
    html_text,
    language_id,
    lm_scoring,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    sharding,
    toxicity,
)
from turnwise.llm import sql as S
from turnwise.llm.common import bounded_batches, documents
from turnwise.session import tune

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(fn: Run) -> Run:
        QUERIES[name] = lambda spark, folder: fn(bounded_batches(tune(spark)), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules", S.QUALITY_RULES)
def op1(spark, folder):
    return quality_rules.apply_rules(documents(spark, folder))


@query("op2_decontamination", S.DECONTAMINATION)
def op2(spark, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.digest(decontamination.find_benchmark(documents(spark, folder).select("doc_id", "text"), benchmark))


@query("op7_best_fit_packing")
def op7(spark, folder):
    return packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_sharding")
def op8(spark, folder):
    return sharding.shard_documents(documents(spark, folder))


@query("op5_near_dedup")
def op5(spark, folder):
    return near_dedup.near_duplicates(documents(spark, folder))


@query("op6_quality_classifier")
def op6(spark, folder):
    return quality_model.predictions(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op9_toxicity")
def op9(spark, folder):
    return toxicity.predictions(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op3_language_id")
def op3(spark, folder):
    return language_id.predictions(documents(spark, folder))


@query("op4_lm_scoring")
def op4(spark, folder):
    return lm_scoring.score_documents(documents(spark, folder))


@query("op10_html_extraction")
def op10(spark, folder):
    return html_text.main_texts(spark.read.parquet(f"{folder}/pages.parquet"))


@query("op11_centroid_clustering", S.CLUSTERING)
def op11(spark, folder):
    return centroids.clustering(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op12_fill_in_middle", S.FILL_IN_MIDDLE)
def op12(spark, folder):
    return fill_middle.digests(documents(spark, folder))


@query("op13_byte_bpe")
def op13(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(documents(spark, folder), path, public_tokenizers.PATTERN)
