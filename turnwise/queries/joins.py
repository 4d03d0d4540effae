"""Engine joins, numbering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import audit, explore
from turnwise.operators.ordering import number_rows
from turnwise.queries.registry import KEYS, engine_rows, enriched, plies, query
from turnwise.sources import adapters, games
from turnwise.sources.adapters import table


@query("enrich_left", """
select physical_game_id, ply_number, player_color, engine_best_move_uci, played_move_rank_top5, is_engine_top1,
  is_engine_top3, centipawn_loss, best_vs_second_cp_gap, is_engine_eval_missing from enriched""", ("enriched",))
def enrich_left(spark, folder):
    return enriched(spark, folder).select(
        *KEYS, "player_color", "engine_best_move_uci", "played_move_rank_top5", "is_engine_top1", "is_engine_top3",
        "centipawn_loss", "best_vs_second_cp_gap", "is_engine_eval_missing",
    )


@query("enrich_inner", """
select physical_game_id, ply_number, game_id, engine_best_move_uci, best_cp, after_cp, centipawn_loss
from enriched where is_engine_eval_missing = 0""", ("enriched",))
def enrich_inner(spark, folder):
    return engine_rows(spark, folder).select(
        *KEYS, "game_id", "engine_best_move_uci", F.col("engine_score_before.cp").alias("best_cp"),
        F.col("engine_score_after.cp").alias("after_cp"), "centipawn_loss",
    )


@query("candidate_rank", """
select physical_game_id, ply_number, move_rank as played_move_rank_top5, coalesce(cast(move_rank = 1 as int), 0) as is_engine_top1,
  coalesce(cast(move_rank <= 3 as int), 0) as is_engine_top3 from engine_rows""", ("engine_rows",), ranks=7)
def candidate_rank(spark, folder):
    """Rank of the played move among seven candidate lines."""
    return engine_rows(spark, folder, 7).select(*KEYS, "played_move_rank_top5", "is_engine_top1", "is_engine_top3")


@query("best_second_gap", """
select physical_game_id, ply_number, best_uci, best_cp, abs(best_cp - second_cp) as gap from engine_rows""", ("engine_rows",))
def best_second_gap(spark, folder):
    return engine_rows(spark, folder).select(
        *KEYS, F.col("engine_best_move_uci").alias("best_uci"), F.col("engine_score_before.cp").alias("best_cp"),
        F.col("best_vs_second_cp_gap").alias("gap"),
    )


@query("depth1_best", """
select physical_game_id, ply_number, shallow_uci, best_uci, shallow_uci = best_uci as stable from engine_rows""", ("engine_rows",))
def depth1_best(spark, folder):
    shallow, best = F.col("engine_best_move_depth1"), F.col("engine_best_move_uci")
    return engine_rows(spark, folder).select(
        *KEYS, shallow.alias("shallow_uci"), best.alias("best_uci"), (shallow == best).alias("stable")
    )


@query("loss_trajectory", """
select physical_game_id, lower(player_color) as series, ply_number, centipawn_loss, centipawn_loss > 200 as over_blunder_line
from plies where centipawn_loss is not null""", ("plies",))
def loss_trajectory(spark, folder):
    return explore.loss_trajectory(plies(spark, folder), game="physical_game_id")


PRIORITIES = ["2-HIGH", "5-LOW", "1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED"]
_PLACE = "case o_orderpriority " + " ".join(f"when '{p}' then {i}" for i, p in enumerate(PRIORITIES)) + " end"


@query("global_game_id", f"""
select o_orderkey, row_number() over (order by {_PLACE}, 'c' || o_custkey, o_orderdate, o_orderkey) as game_id from orders""")
def global_game_id(spark, folder):
    """Orders as games of a customer's file, priorities as categories in a fixed order."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("source_category"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_file"),
    )
    numbered = games.with_game_ids(orders, PRIORITIES, order=["o_orderdate", "o_orderkey"], spread="o_orderdate")
    return numbered.select("o_orderkey", "game_id")


@query("top_n_per_group", """
select o_custkey, o_orderkey, place from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)
  as place from orders) where place <= 3""")
def top_n_per_group(spark, folder):
    """First three orders of each customer, numbered."""
    orders = table(spark, folder, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    few = games.first_n_per_file(orders, 3, file="o_custkey", order="at", place="place")
    return few.select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


def _games(spark, folder):
    """One row per match: category and file of its first ply, and its size."""
    return plies(spark, folder).groupBy("physical_game_id").agg(
        F.min_by(F.struct("source_category", "source_file"), "ply_number").alias("first"),
        F.count(F.lit(1)).alias("moves"),
    ).select("physical_game_id", "first.*", "moves")


_GAMES_SQL = """(select physical_game_id, arg_min(source_category, ply_number) as source_category,
  arg_min(source_file, ply_number) as source_file, count(*) as moves from plies group by 1)"""


@query("category_rollup", f"""
select source_category, source_file, case when grouping(source_category) = 1 then 'total' when grouping(source_file) = 1
  then 'category' else 'file' end as level, count(*) as games, cast(sum(moves) as bigint) as moves
from {_GAMES_SQL} group by rollup (source_category, source_file)""", ("plies",))
def category_rollup(spark, folder):
    return audit.file_rollup(_games(spark, folder))


@query("category_summary", f"""
select c.source_category, coalesce(files, 0) as files, coalesce(games, 0) as games, coalesce(moves, 0) as moves
from (values ('A'), ('N'), ('R'), ('X')) c(source_category) left join (select source_category, count(distinct source_file) as files,
  count(*) as games, cast(sum(moves) as bigint) as moves from {_GAMES_SQL} group by 1) using (source_category)""", ("plies",))
def category_summary(spark, folder):
    return audit.category_summary(_games(spark, folder), ["A", "N", "R", "X"])


@query("semi_sample", """
select physical_game_id, ply_number, game_id from plies where game_id in (select game_id from scored where y = 1 and p >= 0.6)""", ("scored",))
def semi_sample(spark, folder):
    """Plies of the games in a list that another query draws up."""
    p = plies(spark, folder)
    wanted = adapters.scored(p).filter((F.col("y") == 1) & (F.col("p") >= 0.6)).select("game_id").distinct()
    return p.join(wanted, "game_id", "left_semi").select(*KEYS, "game_id")


@query("union_plies", """
select 'white' as series, ply_number, centipawn_loss from plies where player_color = 'White' and centipawn_loss is not null
union all select 'black', ply_number, centipawn_loss from plies where player_color = 'Black' and centipawn_loss is not null""", ("plies",))
def union_plies(spark, folder):
    """Series of both colours under one another."""
    p = plies(spark, folder).filter(F.col("centipawn_loss").isNotNull())
    series = [
        explore.color_plies(p, c).select(F.lit(c).alias("series"), "ply_number", "centipawn_loss") for c in ("white", "black")
    ]
    return series[0].unionByName(series[1])


@query("dialogue_turns", """
select conv_id, role, count(*) as turns, min(turn) as first_turn, max(turn) as last_turn, sum(length(text))::bigint as chars
from conversations group by 1, 2""")
def dialogue_turns(spark, folder):
    """The same sequence profile on another schema: turns as plies, roles as colours."""
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    turns = number_rows(said, ["conv_id"], ["turn"], "ply_number", spread=F.floor(F.col("turn") / 1000))
    return turns.groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("turns"), F.min(F.col("ply_number") - 1).alias("first_turn"),
        F.max(F.col("ply_number") - 1).alias("last_turn"), F.sum("chars").cast("bigint").alias("chars"),
    )
