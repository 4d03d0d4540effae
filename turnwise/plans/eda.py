"""The exploration report: every table behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnwise.operators import audit, explore

# Columns of the report.
MOVE_STATS = ["centipawn_loss", "best_vs_second_cp_gap", "legal_moves_count"]
PROFILE_STATS = ["mean_centipawn_loss", "top1_match_rate", "top3_match_rate", "blunder_rate"]
CORRELATED = [
    "centipawn_loss", "best_vs_second_cp_gap", "legal_moves_count", "is_capture", "is_check",
    "is_engine_top1", "is_engine_top3",
]
HISTOGRAMS = {"centipawn_loss": 25, "best_vs_second_cp_gap": 25, "legal_moves_count": 20}
GROUPS = ["source_category", "game_phase", "player_color"]


def report(moves: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """Named result tables of one move table and its profiles."""
    out = {
        "missing": audit.missing_report(moves),
        "duplicate_moves": audit.duplicate_rows(moves, ["game_id", "ply_number"]),
        "duplicate_profiles": audit.duplicate_rows(profiles, ["game_id", "player_color"]),
        "move_stats": explore.describe(moves, MOVE_STATS),
        "profile_stats": explore.describe(profiles, PROFILE_STATS),
        "correlations": explore.correlations(moves, CORRELATED),
        "ranks": explore.rank_distribution(moves),
        "fence": explore.iqr_fence(moves, "centipawn_loss"),
        "outliers": explore.first_outliers(moves),
        "loss_histogram": explore.loss_histogram(moves),
        "loss_trajectory": explore.loss_trajectory(moves),
    }
    out |= {f"histogram_{c}": explore.histogram(moves, c, n) for c, n in HISTOGRAMS.items()}
    out |= {f"boxplot_{g}": explore.boxplot(moves, g) for g in GROUPS}
    out |= {f"compare_{g}": explore.compare_groups(moves, g) for g in GROUPS}
    return out
