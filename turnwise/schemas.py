"""Column lists and read schemas. Missing is always NULL; only a CSV sink writes empty text."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the published tables.
BASE_PLY_COLUMNS = [
    "game_id", "event", "site", "date", "round", "white_player", "black_player", "white_elo",
    "black_elo", "result", "fullmove_number", "ply_number", "player_color", "player_name",
    "player_elo", "san", "uci", "fen_before", "game_phase",
]
ENGINE_COLUMNS = [
    "engine_best_move_uci", "engine_best_move_san", "engine_best_move_depth1",
    "played_move_rank_top5", "is_engine_top1", "is_engine_top3", "centipawn_loss",
    "best_vs_second_cp_gap", "engine_score_before_cp", "engine_score_after_cp",
]
MOVE_COLUMNS = [
    "game_id", "source_file", "source_category", "event", "site", "date", "round",
    "white_player", "black_player", "white_elo", "black_elo", "result", "fullmove_number",
    "ply_number", "player_color", "player_name", "player_elo", "opponent_name", "opponent_elo",
    "san", "uci", "fen_before", "game_phase", "legal_moves_count", "is_capture", "is_check",
    "is_promotion", "clock_seconds",
    "engine_best_move_uci", "engine_best_move_san", "played_move_rank_top5", "is_engine_top1",
    "is_engine_top3", "centipawn_loss", "best_vs_second_cp_gap", "engine_score_before_cp",
    "engine_score_after_cp", "is_forced_mate", "is_engine_eval_missing", "move_quality",
]
PROFILE_COLUMNS = [
    "game_id", "source_file", "source_category", "event", "site", "date", "round",
    "player_color", "player_name", "player_elo", "opponent_name", "opponent_elo", "result",
    "player_result", "total_moves", "scored_moves", "missing_eval_count", "missing_eval_rate",
    "mate_eval_moves", "mean_centipawn_loss", "median_centipawn_loss", "std_centipawn_loss",
    "min_centipawn_loss", "max_centipawn_loss", "top1_match_count", "top1_match_rate",
    "top3_match_count", "top3_match_rate", "inaccuracy_count", "inaccuracy_rate",
    "mistake_count", "mistake_rate", "blunder_count", "blunder_rate",
    "opening_moves", "opening_scored_moves", "opening_mean_cp_loss", "opening_top1_rate",
    "middlegame_moves", "middlegame_scored_moves", "middlegame_mean_cp_loss",
    "middlegame_top1_rate", "endgame_moves", "endgame_scored_moves", "endgame_mean_cp_loss",
    "endgame_top1_rate", "captures_count", "checks_count", "promotions_count",
]
BASE_FEATURES = [
    "mean_centipawn_loss", "std_centipawn_loss", "median_centipawn_loss", "mean_norm_cp_loss",
    "std_norm_cp_loss", "blunder_rate", "mistake_rate", "inaccuracy_rate", "excellent_rate",
    "top1_match_rate", "used_mean_cp_loss", "used_blunder_rate", "move_count",
]
STABILITY_FEATURES = ["unstable_top1_match_rate", "stable_top1_match_rate", "depth_drop_rate"]
CRITICAL_FEATURES = ["critical_top1_match_rate", "critical_mean_cp_loss"]
COMPLEXITY_FEATURES = STABILITY_FEATURES + CRITICAL_FEATURES
ALL_FEATURES = BASE_FEATURES + COMPLEXITY_FEATURES
#: Columns that carry the label; they must never become features.
LABEL_BEARING = [
    "player_hint_shown", "assistance_search_depth", "assistance_line_rank",
    "is_cheating_move", "is_accused_by_opponent",
]
CATEGORIES = ["human_games", "engine_generated_games", "unlabeled"]

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
          "boolean": T.BooleanType()}


def _columns(text: str) -> T.StructType:
    """Fields of a comma-separated list of names and types; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (item.split() for item in text.split(","))])


# Columns and types of the published benchmark plies and of engine lines.
BENCHMARK_PLIES = _columns("""
    tournament_id string, game_id string, player_id string, opponent_id string, player_color string,
    time_control string, game_result string, player_elo int, opponent_elo int, half_move int,
    move_player string, position_before string, position_after string, move_stockfish_1 string,
    move_stockfish_9 string, move_stockfish_15 string, move_maia2_2050 string, move_allie_2500 string,
    move_thinking_time double, clock_remaining_time double, maia2_win_prob_2050 double,
    allie_win_prob_2500 double, normalized_centipawn_loss double, eval_before bigint, eval_after bigint,
    centipawn_loss bigint, is_used boolean, player_hint_shown boolean, is_cheating_move boolean,
    is_cheating_player_game boolean, is_accused_by_opponent boolean, assistance_search_depth int,
    assistance_line_rank int
""")
ENGINE_LINES = _columns(
    "game_id string, ply_number int, side string, depth int, pv_rank int, uci string, san string, cp int, mate int,"
    " mate_sign int"
)

_INTS = {
    "game_id", "fullmove_number", "ply_number", "legal_moves_count", "is_capture", "is_check",
    "is_promotion", "played_move_rank_top5", "is_engine_top1", "is_engine_top3", "centipawn_loss",
    "best_vs_second_cp_gap", "is_forced_mate", "is_engine_eval_missing",
    "min_centipawn_loss", "max_centipawn_loss",
}


def _table_type(name: str) -> T.DataType:
    if name in _INTS:
        return T.IntegerType()
    if name.endswith(("_count", "_moves")):
        return T.LongType()
    if name == "clock_seconds" or name.endswith("_rate") or name.endswith(("_centipawn_loss", "_mean_cp_loss")):
        return T.DoubleType()
    return T.StringType()


MOVE_TABLE = T.StructType([T.StructField(c, _table_type(c)) for c in MOVE_COLUMNS])
BASE_PLY_TABLE = T.StructType([T.StructField(c, _table_type(c)) for c in BASE_PLY_COLUMNS])
ENGINE_PLY_TABLE = T.StructType([T.StructField(c, _table_type(c)) for c in [*BASE_PLY_COLUMNS, *ENGINE_COLUMNS]])
PROFILE_TABLE = T.StructType([T.StructField(c, _table_type(c)) for c in PROFILE_COLUMNS])
