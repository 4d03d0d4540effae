"""Scores and cards for any number of games."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.learn import models
from turnwise.operators import report
from turnwise.operators.enrich import merge_scored
from turnwise.operators.features import engine_features
from turnwise.schemas import COMPLEXITY_FEATURES


def predict(
    plies: DataFrame,
    lines: DataFrame,
    model: PipelineModel,
    *,
    game: str = "game_id",
    played: str = "uci",
    complexity_model: PipelineModel | None = None,
    require_depth: bool = True,
) -> DataFrame:
    """One scored row per player and game, with its card.

    With a complexity model its gated result comes along in ``experimental``; the depth
    is the greatest one of the game's lines.
    """
    key = [game, "ply_number"]
    merged = merge_scored(plies, lines, keys=key, played=played)
    features = engine_features(
        merged, keys=(game, "player_color"), played=played, complexity=complexity_model is not None
    )
    scored = report.classify(models.score(model, features))
    scored = scored.withColumn(
        "card", report.player_card("classification", "engine_assisted_likelihood", "human_like_likelihood")
    )
    if complexity_model is None:
        return scored
    # both models score the same row, so the features are made once and joined to the depths alone
    depths = lines.groupBy(game).agg(F.max("depth").alias("depth_used"), F.lit(True).alias("__has_depth"))
    both = models.score(complexity_model, scored.join(depths, game, "left"), probability="p_experimental")
    gated = report.depth_gate(
        both.withColumnRenamed("classification", "__class"), "p_experimental", "depth_used", require=require_depth
    )
    fields = ["is_depth_compatible", "status", "depth_used", "required_depth", "score", "classification"]
    shown = [F.when(F.col("score").isNotNull(), F.col(c)).alias(c) for c in COMPLEXITY_FEATURES]
    experimental = F.when(F.col("__has_depth") & F.col("player_color").isNotNull(), F.struct(*fields, *shown))
    return gated.withColumn("experimental", experimental).drop("classification").select(
        *[F.col("__class").alias(c) if c == "classification" else F.col(c) for c in scored.columns], "experimental")
