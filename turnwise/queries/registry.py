"""Registry of queries, and the SQL views their counterparts build on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.enrich import RUN, enrich, merge_scored, run_keys, run_of
from turnwise.session import tune
from turnwise.sources import adapters

Run = Callable[[SparkSession, str], DataFrame]
KEYS = ("physical_game_id", "ply_number")
PLAYER = ("physical_game_id", "player_color")

#: Plies in a task of the engine join; it sorts their lines in memory, some seven times as many rows. A match is
#: dealt out in stretches of 1/1024 of that, so tasks stay even.
POSITION_ROWS = 1 << 16


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), *, ranks: int = 5) -> Callable[[Run], Run]:
    """Register a query; ``views`` names the SQL views its counterpart needs, ``ranks`` the lines per position."""

    def register(fn: Run) -> Run:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        REGISTRY[name] = Query(run, None if sql is None else with_views(sql, views, ranks))
        return fn

    return register


def r6(column: Column | str) -> Column:
    """Six decimals, with negative zero made positive, for comparison across engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def sql_r6(expression: str) -> str:
    return f"(round(cast({expression} as double), 6) + 0.0)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def plies(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.plies(spark, folder)


def position_tasks(spark: SparkSession, folder: str) -> int:
    """Tasks that plies are dealt out to before their lines are sorted.

    Left to itself, Spark sizes tasks by the plies, and the lines of one are many times as large.
    """
    return max(spark.sparkContext.defaultParallelism, -(-adapters.table(spark, folder, "lineitem").count() // POSITION_ROWS))


def positioned(spark: SparkSession, folder: str, ranks: int = 5) -> tuple[DataFrame, DataFrame]:
    """Plies and their candidate lines, both dealt out by stretches of a match; the lines are sorted by position as well.

    Only what plies are made of is dealt out; their columns and lines are made behind that.
    """
    where = ["physical_game_id", RUN]
    items = adapters.numbered_items(spark, folder).select(
        "*", F.col("l_partkey").cast("string").alias("physical_game_id"), run_of("ply_number", max(1, POSITION_ROWS >> 10)).alias(RUN))
    p = adapters.ply_columns(items.repartition(position_tasks(spark, folder), *where), where)
    keys = run_keys(KEYS)
    return p, adapters.engine_lines(p, ranks, keys=keys).sortWithinPartitions(*keys)


def engine_rows(spark: SparkSession, folder: str, ranks: int = 5) -> DataFrame:
    """Plies that have candidate lines, with their engine columns."""
    return merge_scored(*positioned(spark, folder, ranks), keys=KEYS, played="move_player")


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Plies with engine columns, named as the profile wants them."""
    return enrich(*positioned(spark, folder), keys=KEYS, played="move_player").withColumns({
        "player_name": F.col("player_id"), "opponent_name": F.col("opponent_id"),
    })


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.scored(plies(spark, folder))


def array_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _lines_sql(ranks: int = 5) -> str:
    parts = []
    for k in range(1, ranks + 1):
        parts.append(
            f"select physical_game_id, ply_number, 'before' as side, 15 as depth, {k} as pv_rank,"
            f" 'm' || cast((cents + {k - 1}) % 7 as varchar) as uci,"
            f" case when centipawn_loss is null then null when player_color = 'White'"
            f" then eval_before - {k - 1} * (cents % 41) else eval_before + {k - 1} * (cents % 41) end as cp,"
            f" case when centipawn_loss is null then 1 + cents % 5 end as mate from plies where cents % 29 <> 0"
        )
    parts.append(
        "select physical_game_id, ply_number, 'before', 1, 1, move_stockfish_1,"
        " case when centipawn_loss is null then null else eval_before end,"
        " case when centipawn_loss is null then 1 + cents % 5 end"
        " from plies where cents % 29 <> 0 and move_stockfish_1 is not null"
    )
    parts.append(
        "select physical_game_id, ply_number, 'after', 15, 1, null, eval_after,"
        " case when centipawn_loss is null then 1 + cents % 5 end from plies where cents % 29 <> 0"
    )
    return " union all ".join(parts)


_NORM = (
    "greatest(0.0, 1.0/(1.0+exp(-0.00368208*least(greatest({b},-1000.0),1000.0)))"
    " - 1.0/(1.0+exp(-0.00368208*least(greatest({a},-1000.0),1000.0))))"
)
NORM_SQL = (
    "case when eval_before is null or eval_after is null then null when player_color = 'White' then "
    + _NORM.format(b="cast(eval_before as double)", a="cast(eval_after as double)")
    + " else " + _NORM.format(b="cast(-eval_before as double)", a="cast(-eval_after as double)") + " end"
)


def loss_features_sql(loss: str, norm: str) -> str:
    """The measures of a loss column that both feature tables share."""
    def rate(condition: str) -> str:
        return f"avg(case when {loss} is null then null when {condition} then 1.0 else 0.0 end)"

    return (
        f"avg({loss}) as mean_centipawn_loss, stddev_pop({loss}) as std_centipawn_loss,"
        f" median({loss}) as median_centipawn_loss, avg({norm}) as mean_norm_cp_loss,"
        f" stddev_pop({norm}) as std_norm_cp_loss,"
        f" {rate(f'{loss} > 200')} as blunder_rate, {rate(f'{loss} > 100 and {loss} <= 200')} as mistake_rate,"
        f" {rate(f'{loss} > 50 and {loss} <= 100')} as inaccuracy_rate, {rate(f'{loss} <= 25')} as excellent_rate,"
        " count(*) as move_count"
    )


_HIT = "case when move_player = move_stockfish_15 then 1.0 else 0.0 end"

#: Views in the order of their dependencies.
VIEWS: dict[str, str] = {
    "plies": """
plies_c as (select *, cast(round(l_extendedprice*100) as bigint) as cents,
  row_number() over (partition by l_partkey order by l_shipdate,l_orderkey,l_linenumber,l_suppkey) as ply_number
  from lineitem),
plies_l as (select *, cents % 1000 as u, ply_number % 2 as side, ply_number >= 21 as is_used from plies_c),
plies_m as (select *, case when u % 37 = 0 then null else (u*u*u)//2500000 end as centipawn_loss,
  (cents//7) % 2001 - 1000 as eval_before from plies_l),
plies as (select cast(l_partkey as varchar) as physical_game_id,
  cast(l_partkey as varchar) || case when side = 1 then '_w' else '_b' end as game_id,
  'p' || cast((l_partkey*5 + side*13) % 49 as varchar) as player_id,
  'p' || cast((l_partkey*5 + (1-side)*13) % 49 as varchar) as opponent_id,
  case when side = 1 then 'White' else 'Black' end as player_color, ply_number, cents, is_used,
  case when ply_number <= 12 then 'Opening' when ply_number <= 30 then 'Middlegame' else 'Endgame' end as game_phase,
  centipawn_loss, eval_before,
  case when side = 1 then eval_before - centipawn_loss else eval_before + centipawn_loss end as eval_after,
  case when is_used then 'm' || cast((cents//5) % 7 as varchar) end as move_stockfish_1,
  case when is_used then 'm' || cast(cents % 7 as varchar) end as move_stockfish_15,
  case when (cents//25) % 10 < 4 then 'm' || cast(cents % 7 as varchar)
       else 'm' || cast((cents//11) % 7 as varchar) end as move_player,
  cast(cast(l_quantity as bigint) % 5 = 0 as int) as is_capture, cast((cents//3) % 11 = 0 as int) as is_check,
  cast((cents//13) % 97 = 0 as int) as is_promotion, cast(1 + (cents//9) % 45 as int) as legal_moves_count,
  l_returnflag as source_category, (l_partkey*3 + side) % 5 < 2 as is_cheating_player_game,
  (l_partkey*3 + side) % 5 < 2 and cents % 3 = 0 as is_cheating_move,
  'file' || cast(l_partkey % 20 as varchar) || '.pgn' as source_file, 'E' || cast(l_partkey % 10 as varchar) as event,
  case when l_partkey % 7 = 0 then '?' else 'S' || cast(l_partkey % 7 as varchar) end as site,
  case when l_partkey % 6 = 0 then '????.??.??' else '2024.01.15' end as date,
  case when l_partkey % 5 = 0 then '-' else cast(l_partkey % 5 as varchar) end as round,
  case l_partkey % 4 when 0 then '1-0' when 1 then '0-1' when 2 then '1/2-1/2' else '*' end as result,
  case when l_partkey % 9 = 0 then '' else cast(1000 + (l_partkey*7 + side*31) % 1500 as varchar) end as player_elo,
  case when l_partkey % 9 = 0 then '' else cast(1000 + (l_partkey*7 + (1-side)*31) % 1500 as varchar) end as opponent_elo
  from plies_m)""",
    "engine_lines": f"\nengine_lines as ({_lines_sql()})",
    "engine_rows": """
by_position as (select physical_game_id, ply_number,
  max(case when side = 'before' and depth = 15 and pv_rank = 1 then uci end) as best_uci,
  max(case when side = 'before' and depth = 15 and pv_rank = 1 then cp end) as best_cp,
  max(case when side = 'before' and depth = 15 and pv_rank = 1 then mate end) as best_mate,
  max(case when side = 'before' and depth = 15 and pv_rank = 2 then cp end) as second_cp,
  max(case when side = 'after' then cp end) as after_cp,
  max(case when side = 'after' then mate end) as after_mate,
  max(case when side = 'before' and depth = 1 then uci end) as shallow_uci
  from engine_lines group by 1, 2),
played_rank as (select l.physical_game_id, l.ply_number, min(l.pv_rank) as r from engine_lines l
  join plies p on p.physical_game_id = l.physical_game_id and p.ply_number = l.ply_number and p.move_player = l.uci
  where side = 'before' and depth = 15 group by 1, 2),
engine_rows as (select b.*, r.r as move_rank,
  case when p.player_color = 'White' then least(greatest(best_cp - after_cp, 0), 2000)
       when best_cp is not null and after_cp is not null
       then least(greatest(after_cp - best_cp, 0), 2000) end as raw_loss
  from by_position b join plies p using (physical_game_id, ply_number)
  left join played_rank r using (physical_game_id, ply_number))""",
    "enriched": """
enriched as (select p.* exclude (centipawn_loss), e.best_uci as engine_best_move_uci,
  e.shallow_uci as engine_best_move_depth1, e.best_cp, e.after_cp,
  e.move_rank as played_move_rank_top5,
  case when e.ply_number is not null then coalesce(cast(e.move_rank = 1 as int), 0) end as is_engine_top1,
  case when e.ply_number is not null then coalesce(cast(e.move_rank <= 3 as int), 0) end as is_engine_top3,
  case when e.best_cp is null or e.after_cp is null then null else e.raw_loss end as centipawn_loss,
  abs(e.best_cp - e.second_cp) as best_vs_second_cp_gap,
  case when e.ply_number is not null
       then cast(e.best_mate is not null or e.after_mate is not null as int) end as is_forced_mate,
  cast(e.ply_number is null as int) as is_engine_eval_missing
  from plies p left join engine_rows e using (physical_game_id, ply_number))""",
    "scored": """
scored as (select game_id, physical_game_id, max(case when is_cheating_player_game then 1 else 0 end) as y,
  (coalesce(sum(centipawn_loss),0) % 81 + 20*max(case when is_cheating_player_game then 1 else 0 end))/100.0e0 as p,
  (coalesce(sum(centipawn_loss),0) % 61 + 40*max(case when is_cheating_player_game then 1 else 0 end))/100.0e0
    as p_other
  from plies group by game_id, physical_game_id)""",
    "features": f"""
features as (select game_id, physical_game_id, arg_min(player_id, ply_number) as player_id,
  arg_min(player_color, ply_number) as player_color,
  cast(arg_min(is_cheating_player_game, ply_number) as int) as is_cheating,
  {loss_features_sql("centipawn_loss", f"({NORM_SQL})")},
  avg(case when is_used then {_HIT} end) as top1_match_rate,
  avg(case when is_used then centipawn_loss end) as used_mean_cp_loss,
  avg(case when is_used and centipawn_loss is not null then case when centipawn_loss > 100 then 1.0 else 0.0 end end)
    as used_blunder_rate,
  avg(case when is_used and move_stockfish_1 is distinct from move_stockfish_15 then {_HIT} end)
    as unstable_top1_match_rate,
  avg(case when is_used and move_stockfish_1 = move_stockfish_15 then {_HIT} end) as stable_top1_match_rate,
  avg(case when is_used and move_stockfish_1 = move_stockfish_15 then {_HIT} end)
   - avg(case when is_used and move_stockfish_1 is distinct from move_stockfish_15 then {_HIT} end) as depth_drop_rate,
  avg(case when is_used and abs(eval_before) <= 200 then {_HIT} end) as critical_top1_match_rate,
  avg(case when is_used and abs(eval_before) <= 200 then centipawn_loss end) as critical_mean_cp_loss
  from plies group by game_id, physical_game_id)""",
    "folded": """
fold_groups as (select physical_game_id, count(*) as n_rows, sum(y) as n_pos from scored group by 1),
fold_dealt as (select *, row_number() over (partition by n_rows, n_pos
  order by md5(physical_game_id || ':42'), physical_game_id) as place from fold_groups),
folded as (select physical_game_id, n_rows, n_pos, cast((place - 1 + n_rows + n_pos) % 5 as int) as fold
  from fold_dealt)""",
}

_NEEDS = {
    "plies": (), "engine_lines": ("plies",), "engine_rows": ("engine_lines",), "enriched": ("engine_rows",),
    "scored": ("plies",), "features": ("plies",), "folded": ("scored",),
}


def with_views(sql: str, views: tuple[str, ...], ranks: int = 5) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for need in _NEEDS[name]:
            add(need)

    for view in views:
        add(view)
    texts = VIEWS | {"engine_lines": f"\nengine_lines as ({_lines_sql(ranks)})"}
    ctes = [texts[name] for name in texts if name in wanted]
    return f"with {','.join(ctes)}\n{sql.strip()}" if ctes else sql.strip()
