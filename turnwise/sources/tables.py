"""Parquet, CSV and JSON tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.schemas import (
    BASE_PLY_TABLE,
    BENCHMARK_PLIES,
    ENGINE_LINES,
    ENGINE_PLY_TABLE,
    MOVE_TABLE,
    PROFILE_TABLE,
)

_FLOATS = (T.DoubleType, T.FloatType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, the one spelling of missing."""
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, _FLOATS) else F.col(f.name)
        for f in df.schema.fields
    ])


def benchmark_plies(spark: SparkSession, path: str) -> DataFrame:
    """Labelled plies, 33 columns."""
    return nan_to_null(spark.read.schema(BENCHMARK_PLIES).parquet(path))


def engine_lines(spark: SparkSession, path: str) -> DataFrame:
    """Engine candidate lines: one row per game, ply, side, depth and rank."""
    return spark.read.schema(ENGINE_LINES).parquet(path)


def move_table(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, MOVE_TABLE)


def base_ply_table(spark: SparkSession, path: str) -> DataFrame:
    """Base plies as a batch writes them, 19 columns."""
    return _csv(spark, path, BASE_PLY_TABLE)


def engine_ply_table(spark: SparkSession, path: str) -> DataFrame:
    """The enriched copy of the base plies, 29 columns."""
    return _csv(spark, path, ENGINE_PLY_TABLE)


def profile_table(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PROFILE_TABLE)


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False)
        .option("escape", '"').csv(path)
    )


MANIFEST_FILES = T.StructType([
    T.StructField("files_processed", T.ArrayType(T.StructType([
        T.StructField("file", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("games_processed", T.LongType()),
        T.StructField("moves_extracted", T.LongType()),
        T.StructField("provenance_audit", T.StructType([
            T.StructField("provenance_status", T.StringType()),
            T.StructField("authenticity", T.StringType()),
        ])),
    ])))
])


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a manifest document as rows, with their provenance."""
    return (
        spark.read.schema(MANIFEST_FILES).option("multiLine", True).json(path)
        .select(F.explode("files_processed").alias("f"))
        .select(
            "f.file", "f.category", F.col("f.moves_extracted").alias("moves"),
            "f.provenance_audit.provenance_status", "f.provenance_audit.authenticity",
        )
    )


def document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document written by the sinks."""
    return spark.read.schema(schema).json(path)
