"""Model features per player and game: 13 base features and 5 on position complexity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import moves as M
from turnwise.functions.numeric import share
from turnwise.schemas import BASE_FEATURES, COMPLEXITY_FEATURES


def _loss_features(loss: Column, norm: Column) -> list[Column]:
    scored = loss.isNotNull()
    return [
        F.avg(loss).alias("mean_centipawn_loss"),
        F.stddev_pop(loss).alias("std_centipawn_loss"),
        F.median(loss).alias("median_centipawn_loss"),
        F.avg(norm).alias("mean_norm_cp_loss"),
        F.stddev_pop(norm).alias("std_norm_cp_loss"),
        share(loss > M.MISTAKE_MAX, scored).alias("blunder_rate"),
        share((loss > M.INACCURACY_MAX) & (loss <= M.MISTAKE_MAX), scored).alias("mistake_rate"),
        share((loss > M.GOOD_MAX) & (loss <= M.INACCURACY_MAX), scored).alias("inaccuracy_rate"),
        share(loss <= M.EXCELLENT_MAX, scored).alias("excellent_rate"),
        F.count(F.lit(1)).alias("move_count"),
    ]


def _complexity(
    used: Column, unstable: Column, stable: Column, deep_hit: Column, crit_hit: Column, eval_before: Column, loss: Column
) -> list[Column]:
    critical = used & F.coalesce(F.abs(eval_before) <= M.CRITICAL_EVAL, F.lit(False))
    return [
        share(deep_hit, used & unstable).alias("unstable_top1_match_rate"),
        share(deep_hit, used & stable).alias("stable_top1_match_rate"),
        share(crit_hit, critical).alias("critical_top1_match_rate"),
        F.avg(F.when(critical, loss)).alias("critical_mean_cp_loss"),
    ]


def _finish(grouped: DataFrame, keys: Sequence[str], complexity: bool) -> DataFrame:
    if not complexity:
        return grouped.select(*keys, *BASE_FEATURES)
    return grouped.withColumn(
        "depth_drop_rate", F.col("stable_top1_match_rate") - F.col("unstable_top1_match_rate")
    ).select(*keys, *BASE_FEATURES, *COMPLEXITY_FEATURES)


def benchmark_features(plies: DataFrame, *, order: str = "half_move", complexity: bool = False) -> DataFrame:
    """Features of labelled plies, one row per ``game_id``.

    Used-ply measures are NULL for a game without a used ply. A missing shallow or deep
    best move makes a position unstable. Identifiers and the label are those of the
    first ply.
    """
    loss = F.col("centipawn_loss")
    used = F.coalesce(F.col("is_used"), F.lit(False))
    hit = F.coalesce(F.col("move_player") == F.col("move_stockfish_15"), F.lit(False))
    norm = (
        F.col("normalized_centipawn_loss")
        if "normalized_centipawn_loss" in plies.columns
        else M.win_prob_loss(M.mover_view("eval_before", "player_color"), M.mover_view("eval_after", "player_color"))
    )
    ids = F.struct("player_id", "player_color", F.col("is_cheating_player_game").cast("int").alias("is_cheating"))
    aggs = [
        F.min_by(ids, F.col(order)).alias("__ids"),
        *_loss_features(loss, norm),
        share(hit, used).alias("top1_match_rate"),
        F.avg(F.when(used, loss)).alias("used_mean_cp_loss"),
        share(loss > M.INACCURACY_MAX, used & loss.isNotNull()).alias("used_blunder_rate"),
    ]
    if complexity:
        stable = F.coalesce(F.col("move_stockfish_1") == F.col("move_stockfish_15"), F.lit(False))
        aggs += _complexity(used, ~stable, stable, hit, hit, F.col("eval_before"), loss)
    grouped = plies.groupBy("game_id").agg(*aggs).select(
        "*", "__ids.*", M.match_id("game_id").alias("physical_game_id")
    )
    keys = ["game_id", "physical_game_id", "player_id", "player_color", "is_cheating"]
    return _finish(grouped, keys, complexity)


def engine_features(
    plies: DataFrame,
    *,
    keys: Sequence[str] = ("game_id", "player_color"),
    ply: str = "ply_number",
    played: str = "uci",
    complexity: bool = False,
) -> DataFrame:
    """Features of engine-scored plies, one row per player and game.

    Scores are in white's view. Plies from 21 on are decision points; a game that ends
    earlier uses all of its plies for the three decision measures, but not for the
    complexity ones, which also need all three moves to be present.
    """
    color = keys[-1]
    loss = F.col("centipawn_loss")
    before, after = F.col("engine_score_before.cp"), F.col("engine_score_after.cp")
    norm = M.win_prob_loss(M.mover_view(before, color), M.mover_view(after, color))
    used = F.coalesce(F.col(ply) >= M.DECISION_PLY, F.lit(False))
    top1 = F.coalesce(F.col("is_engine_top1") == 1, F.lit(False))

    def decision(measure) -> Column:
        """Over used plies, or over all of them where none is used."""
        return F.when(F.bool_or(used), measure(used)).otherwise(measure(F.lit(True)))

    aggs = [
        *_loss_features(loss, norm),
        decision(lambda among: share(top1, among)).alias("top1_match_rate"),
        decision(lambda among: F.avg(F.when(among, loss))).alias("used_mean_cp_loss"),
        decision(lambda among: share(loss > M.INACCURACY_MAX, among & loss.isNotNull())).alias("used_blunder_rate"),
    ]
    if complexity:
        shallow, deep, move = F.col("engine_best_move_depth1"), F.col("engine_best_move_uci"), F.col(played)
        known = shallow.isNotNull() & deep.isNotNull() & move.isNotNull()
        aggs += _complexity(
            used, known & (shallow != deep), known & (shallow == deep), move == deep, top1, before, loss
        )
    return _finish(plies.groupBy(*keys).agg(*aggs), list(keys), complexity)
