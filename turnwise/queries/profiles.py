"""Player-game profiles and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import explore
from turnwise.operators.features import benchmark_features, engine_features
from turnwise.operators.profile import loss_stats as loss_aggregates
from turnwise.operators.profile import profile
from turnwise.functions.numeric import rate
from turnwise.queries.registry import (
    NORM_SQL, PLAYER, enriched, loss_features_sql, plies, query, r6, rounded, sql_r6,
)
from turnwise.schemas import BASE_FEATURES, COMPLEXITY_FEATURES

_CONTEXT_SQL = ", ".join(
    f"arg_min({src}, ply_number) as {name}"
    for name, src in [
        ("source_file", "source_file"), ("source_category", "source_category"), ("event", "event"), ("site", "site"),
        ("date", "date"), ("round", "round"), ("player_name", "player_id"), ("player_elo", "player_elo"),
        ("opponent_name", "opponent_id"), ("opponent_elo", "opponent_elo"), ("result", "result"),
    ]
)


def _count(condition: str, name: str) -> str:
    return f"count(*) filter ({condition}) as {name}"


def _rate(numerator: str, denominator: str, name: str) -> str:
    return f"{sql_r6(f'count(*) filter ({numerator}) / nullif({denominator}, 0)')} as {name}"


_SCORED = "count(centipawn_loss)"
_TIERS = {
    "top1_match": "is_engine_top1 = 1", "top3_match": "is_engine_top3 = 1",
    "inaccuracy": "centipawn_loss > 50 and centipawn_loss <= 100",
    "mistake": "centipawn_loss > 100 and centipawn_loss <= 200", "blunder": "centipawn_loss > 200",
}
_PHASE_SQL = ", ".join(
    f"{_count(f'game_phase = {p!r}', f'{p.lower()}_moves')},"
    f" {_count(f'game_phase = {p!r} and centipawn_loss is not null', f'{p.lower()}_scored_moves')},"
    f" {sql_r6(f'avg(centipawn_loss) filter (game_phase = {p!r})')} as {p.lower()}_mean_cp_loss,"
    + _rate(
        f"game_phase = {p!r} and is_engine_top1 = 1",
        f"count(*) filter (game_phase = {p!r} and centipawn_loss is not null)", f"{p.lower()}_top1_rate",
    )
    for p in ("Opening", "Middlegame", "Endgame")
)
_STD = "case when count(centipawn_loss) = 1 then 0.0 else stddev_samp(centipawn_loss) end"

PROFILE_SQL = f"""
select physical_game_id, player_color, {_CONTEXT_SQL},
  case arg_min(result, ply_number) when '1/2-1/2' then 'draw' when '*' then 'unknown'
    when '1-0' then case when player_color = 'White' then 'win' else 'loss' end
    else case when player_color = 'White' then 'loss' else 'win' end end as player_result,
  count(*) as total_moves, {_SCORED} as scored_moves,
  {_count('is_engine_eval_missing = 1', 'missing_eval_count')},
  {sql_r6('count(*) filter (is_engine_eval_missing = 1) / count(*)')} as missing_eval_rate,
  {_count('is_forced_mate = 1', 'mate_eval_moves')},
  {sql_r6('avg(centipawn_loss)')} as mean_centipawn_loss, {sql_r6('median(centipawn_loss)')} as median_centipawn_loss,
  {sql_r6(_STD)} as std_centipawn_loss, cast(min(centipawn_loss) as int) as min_centipawn_loss,
  cast(max(centipawn_loss) as int) as max_centipawn_loss,
  {', '.join(_count(c, f'{t}_count') for t, c in _TIERS.items())},
  {', '.join(_rate(c, _SCORED, f'{t}_rate') for t, c in _TIERS.items())},
  {_PHASE_SQL},
  cast(sum(is_capture) as bigint) as captures_count, cast(sum(is_check) as bigint) as checks_count,
  cast(sum(is_promotion) as bigint) as promotions_count
from enriched group by physical_game_id, player_color"""


@query("player_game_profile", PROFILE_SQL, ("enriched",))
def player_game_profile(spark, folder):
    out = profile(enriched(spark, folder), keys=PLAYER)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return rounded(out, *doubles)


@query("phase_profile", f"select physical_game_id, player_color, {_PHASE_SQL} from enriched group by 1, 2", ("enriched",))
def phase_profile(spark, folder):
    out = profile(enriched(spark, folder), keys=PLAYER)
    names = [f"{p}_{m}" for p in ("opening", "middlegame", "endgame") for m in ("moves", "scored_moves", "mean_cp_loss", "top1_rate")]
    return rounded(out.select(*PLAYER, *names), *[n for n in names if n.endswith(("_loss", "_rate"))])


@query("loss_stats", f"""
select game_id, {sql_r6('avg(centipawn_loss)')} as mean, {sql_r6('median(centipawn_loss)')} as median,
  {sql_r6(_STD)} as std, min(centipawn_loss) as min, max(centipawn_loss) as max from plies group by 1""", ("plies",))
def loss_stats(spark, folder):
    return rounded(
        plies(spark, folder).groupBy("game_id").agg(*loss_aggregates(F.col("centipawn_loss"))), "mean", "median", "std"
    )


@query("safe_rate", f"""
select game_id, {sql_r6('count(*) filter (centipawn_loss > 100) / nullif(count(*) filter (game_phase = $$Endgame$$), 0)')} as rate
from plies group by 1""", ("plies",))
def safe_rate(spark, folder):
    """Losses above 100 per endgame ply; games without one have no rate."""
    return plies(spark, folder).groupBy("game_id").agg(
        r6(rate(F.count_if(F.col("centipawn_loss") > 100), F.count_if(F.col("game_phase") == "Endgame"))).alias("rate")
    )


_DOUBLES = [c for c in BASE_FEATURES if c != "move_count"]
_IDS = "game_id, physical_game_id, player_id, player_color, is_cheating"


def _features_sql(columns: list[str]) -> str:
    return f"select {_IDS}, {', '.join(f'{sql_r6(c)} as {c}' for c in columns)}"


@query("player_features_13", f"{_features_sql(_DOUBLES)}, move_count from features", ("features",))
def player_features_13(spark, folder):
    return rounded(benchmark_features(plies(spark, folder), order="ply_number"), *_DOUBLES)


@query("complexity_features", f"{_features_sql(COMPLEXITY_FEATURES)} from features", ("features",))
def complexity_features(spark, folder):
    out = benchmark_features(plies(spark, folder), order="ply_number", complexity=True)
    ids = [c.strip() for c in _IDS.split(",")]
    return rounded(out.select(*ids, *COMPLEXITY_FEATURES), *COMPLEXITY_FEATURES)


_ENGINE_NORM = NORM_SQL.replace("eval_before", "best_cp").replace("eval_after", "after_cp")
_TOP1 = "case when is_engine_top1 = 1 then 1.0 else 0.0 end"


def _decision(measure: str) -> str:
    """A measure over used plies, or over all where none is used."""
    used = measure.format(among="is_used")
    return f"case when bool_or(is_used) then {used} else {measure.format(among='true')} end"


_BIG = "avg(case when centipawn_loss > 100 then 1.0 else 0.0 end) filter ({among} and centipawn_loss is not null)"
_DEEP_HIT = "case when move_player = engine_best_move_uci then 1.0 else 0.0 end"
_ENGINE_FEATURES = {
    "top1_match_rate": _decision(f"avg({_TOP1}) filter ({{among}})"),
    "used_mean_cp_loss": _decision("avg(centipawn_loss) filter ({among})"),
    "used_blunder_rate": _decision(_BIG),
    "unstable_top1_match_rate":
        f"avg({_DEEP_HIT}) filter (is_used and engine_best_move_depth1 <> engine_best_move_uci)",
    "stable_top1_match_rate":
        f"avg({_DEEP_HIT}) filter (is_used and engine_best_move_depth1 = engine_best_move_uci)",
    "critical_top1_match_rate": f"avg({_TOP1}) filter (is_used and abs(best_cp) <= 200)",
    "critical_mean_cp_loss": "avg(centipawn_loss) filter (is_used and abs(best_cp) <= 200)",
}
_ALL_DOUBLES = [*_DOUBLES, *COMPLEXITY_FEATURES]


@query("player_features_engine", f"""
select physical_game_id, player_color, {', '.join(f'{sql_r6(c)} as {c}' for c in _ALL_DOUBLES)}, move_count from (
  select *, stable_top1_match_rate - unstable_top1_match_rate as depth_drop_rate from (
    select physical_game_id, player_color, {loss_features_sql("centipawn_loss", f"({_ENGINE_NORM})")},
      {', '.join(f'{e} as {n}' for n, e in _ENGINE_FEATURES.items())}
    from enriched group by 1, 2))""", ("enriched",))
def player_features_engine(spark, folder):
    out = engine_features(enriched(spark, folder), keys=PLAYER, played="move_player", complexity=True)
    return rounded(out, *_ALL_DOUBLES)


@query("side_by_side", " union all ".join(
    f"""select physical_game_id, '{f}' as feature, {sql_r6(f"max(case when player_color = 'White' then {f} end)")} as white,
    {sql_r6(f"max(case when player_color = 'Black' then {f} end)")} as black from features group by 1"""
    for f in BASE_FEATURES
), ("features",))
def side_by_side(spark, folder):
    features = benchmark_features(plies(spark, folder), order="ply_number")
    return rounded(explore.side_by_side(features, BASE_FEATURES, game="physical_game_id"), "white", "black")


def _breakdown_sql(label: str, feature: str) -> str:
    side = "coalesce(max(case when player_color = '{c}' then round(coalesce({f}, 0)*100, 1) end), 0.0)"
    return (
        f"select physical_game_id, '{label}' as category, {sql_r6(side.format(c='White', f=feature))} as white_pct,"
        f" {sql_r6(side.format(c='Black', f=feature))} as black_pct from features group by 1"
    )


@query("quality_breakdown", " union all ".join(_breakdown_sql(b, f) for b, f in explore.BREAKDOWN.items()), ("features",))
def quality_breakdown(spark, folder):
    features = benchmark_features(plies(spark, folder), order="ply_number")
    return rounded(explore.quality_breakdown(features, game="physical_game_id"), "white_pct", "black_pct")
