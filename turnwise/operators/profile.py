"""One profile row per player and game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import moves as M
from turnwise.functions.numeric import rate, round_exact

CONTEXT = [
    "source_file", "source_category", "event", "site", "date", "round", "player_name",
    "player_elo", "opponent_name", "opponent_elo", "result",
]


def loss_stats(loss: Column, prefix: str = "") -> list[Column]:
    """Aggregates: mean, median, sample deviation (0.0 for one value), min, max."""
    std = F.when(F.count(loss) == 1, F.lit(0.0)).otherwise(F.stddev_samp(loss))
    return [
        F.avg(loss).alias(f"{prefix}mean"),
        F.median(loss).alias(f"{prefix}median"),
        std.alias(f"{prefix}std"),
        F.min(loss).alias(f"{prefix}min"),
        F.max(loss).alias(f"{prefix}max"),
    ]


def profile(
    plies: DataFrame,
    *,
    keys: Sequence[str] = ("game_id", "player_color"),
    context: Sequence[str] = CONTEXT,
    order: str = "ply_number",
    strict_rates: bool = False,
    rounded: bool = False,
) -> DataFrame:
    """Aggregate enriched plies to player-game profiles in one pass.

    Match counts take every ply flagged top-1/top-3, mates included, over scored plies,
    so a rate can pass 1; ``strict_rates`` counts scored plies only. The context comes
    from the first ply. ``rounded`` gives the published precision (2 and 4 decimals).

    The loss is a whole number in [0, 2000], so the buffer behind the median has at most
    2001 entries however many plies a key holds.
    """
    loss = F.col("centipawn_loss")
    top1, top3 = F.col("is_engine_top1") == 1, F.col("is_engine_top3") == 1
    if strict_rates:
        top1, top3 = top1 & loss.isNotNull(), top3 & loss.isNotNull()
    counts = {
        "total_moves": F.count(F.lit(1)),
        "scored_moves": F.count(loss),
        "missing_eval_count": F.count_if(F.col("is_engine_eval_missing") == 1),
        "mate_eval_moves": F.count_if(F.col("is_forced_mate") == 1),
        "top1_match_count": F.count_if(top1),
        "top3_match_count": F.count_if(top3),
        "inaccuracy_count": F.count_if((loss > M.GOOD_MAX) & (loss <= M.INACCURACY_MAX)),
        "mistake_count": F.count_if((loss > M.INACCURACY_MAX) & (loss <= M.MISTAKE_MAX)),
        "blunder_count": F.count_if(loss > M.MISTAKE_MAX),
        "captures_count": F.coalesce(F.sum("is_capture"), F.lit(0)),
        "checks_count": F.coalesce(F.sum("is_check"), F.lit(0)),
        "promotions_count": F.coalesce(F.sum("is_promotion"), F.lit(0)),
    }
    by_phase = []
    for phase in M.PHASES:
        here, name = F.col("game_phase") == phase, phase.lower()
        by_phase += [
            F.count_if(here).alias(f"{name}_moves"),
            F.count_if(here & loss.isNotNull()).alias(f"{name}_scored_moves"),
            F.avg(F.when(here, loss)).alias(f"{name}_mean_cp_loss"),
            F.count_if(here & top1).alias(f"__{name}_top1"),
        ]
    grouped = plies.groupBy(*keys).agg(
        F.min_by(F.struct(*context), F.col(order)).alias("__first"),
        *[c.cast("bigint").alias(n) for n, c in counts.items()],
        *loss_stats(loss, "__"),
        *by_phase,
    )

    scored = F.col("scored_moves")
    rates = {
        f"{tier}_rate": rate(F.col(f"{tier}_count"), scored)
        for tier in ("top1_match", "top3_match", "inaccuracy", "mistake", "blunder")
    }
    rates["missing_eval_rate"] = F.coalesce(
        rate(F.col("missing_eval_count"), F.col("total_moves")), F.lit(0.0)
    )
    for phase in M.PHASES:
        name = phase.lower()
        rates[f"{name}_top1_rate"] = rate(F.col(f"__{name}_top1"), F.col(f"{name}_scored_moves"))
    stats = {
        "mean_centipawn_loss": F.col("__mean"),
        "median_centipawn_loss": F.col("__median"),
        "std_centipawn_loss": F.col("__std"),
        **{f"{p.lower()}_mean_cp_loss": F.col(f"{p.lower()}_mean_cp_loss") for p in M.PHASES},
    }
    if rounded:
        rates = {n: round_exact(c, 4) for n, c in rates.items()}
        stats = {n: round_exact(c, 2) for n, c in stats.items()}
    derived = {
        **{c: F.col(f"__first.{c}") for c in context},
        **stats,
        **rates,
        "min_centipawn_loss": F.col("__min").cast("int"),
        "max_centipawn_loss": F.col("__max").cast("int"),
    }
    if "result" in context:
        derived["player_result"] = M.player_result(F.col("__first.result"), keys[-1])
    plain = [c for c in grouped.columns if not c.startswith("__") and c not in derived]
    return grouped.select(*plain, *[c.alias(n) for n, c in derived.items()])
