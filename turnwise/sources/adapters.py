"""Views that give star-schema tables the shape of ply, engine-line and score tables.

A part is taken as a match, each of its line items as a ply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.ordering import HOT_ROWS, number_rows

#: Move texts that stand in for SAN, picked by ``cents % 10``.
SAN_SAMPLES = ["e4", "Nf3", "Bxc6+", "O-O", "exd5", "Qh5#", "e8=Q", "Rad1", "O-O-O+", "bxa1=N+"]

#: Placement texts that stand in for positions, picked by ``cents % 4``.
FEN_SAMPLES = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "r1bqk2r/pp3ppp/8/8/8/8/PPP2PPP/R1BQK2R b KQkq - 3 12",
    "4k3/1r6/8/8/8/5N2/6Q1/4K3 w - - 0 50",
    "2rq1rk1/8/8/8/8/8/8/2RQ1RK1 b - - 2 30",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plies(spark: SparkSession, folder: str, *, hot_rows: int = HOT_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line item, numbered within its part by ship date."""
    return ply_columns(numbered_items(spark, folder, hot_rows=hot_rows), keep)


def numbered_items(spark: SparkSession, folder: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The few columns that plies are made of; what is to be shuffled is shuffled in this form."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
    items = table(spark, folder, "lineitem").select(
        "l_partkey",
        *order,
        "l_quantity",
        "l_returnflag",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    numbered = number_rows(
        items, ["l_partkey"], order, "ply_number", spread=F.struct("l_shipdate", F.shiftright("l_orderkey", 16)), hot_rows=hot_rows)
    return numbered.drop(*order)


def ply_columns(numbered: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ply measures and context of numbered line items; row by row, no shuffle.

    Columns in ``keep`` stay as they are, also in place of one made here, so rows stay dealt out by them.
    """
    base = numbered.selectExpr(
        *[c for c in keep if c != "l_partkey"],
        "l_partkey",
        "l_quantity",
        "l_returnflag as source_category",
        "cents",
        "ply_number",
        "cents % 1000 as u",
        "ply_number % 2 as side",
        "(cents div 7) % 2001 - 1000 as eval_before",
        "ply_number >= 21 as is_used",
    ).selectExpr("*", "case when u % 37 = 0 then null else (u*u*u) div 2500000 end as centipawn_loss")
    columns = [
        "cast(l_partkey as string) as physical_game_id",
        "concat(cast(l_partkey as string), case when side = 1 then '_w' else '_b' end) as game_id",
        "concat('p', cast((l_partkey * 5 + side * 13) % 49 as string)) as player_id",
        "concat('p', cast((l_partkey * 5 + (1 - side) * 13) % 49 as string)) as opponent_id",
        "case when side = 1 then 'White' else 'Black' end as player_color",
        "ply_number",
        "cents",
        "is_used",
        "case when ply_number <= 12 then 'Opening' when ply_number <= 30 then 'Middlegame'"
        " else 'Endgame' end as game_phase",
        "centipawn_loss",
        "eval_before",
        "case when side = 1 then eval_before - centipawn_loss else eval_before + centipawn_loss end as eval_after",
        "case when is_used then concat('m', cast((cents div 5) % 7 as string)) end as move_stockfish_1",
        "case when is_used then concat('m', cast(cents % 7 as string)) end as move_stockfish_15",
        "case when (cents div 25) % 10 < 4 then concat('m', cast(cents % 7 as string))"
        " else concat('m', cast((cents div 11) % 7 as string)) end as move_player",
        "cast(cast(l_quantity as bigint) % 5 = 0 as int) as is_capture",
        "cast((cents div 3) % 11 = 0 as int) as is_check",
        "cast((cents div 13) % 97 = 0 as int) as is_promotion",
        "cast(1 + (cents div 9) % 45 as int) as legal_moves_count",
        "source_category",
        "(l_partkey * 3 + side) % 5 < 2 as is_cheating_player_game",
        "(l_partkey * 3 + side) % 5 < 2 and cents % 3 = 0 as is_cheating_move",
        "concat('file', cast(l_partkey % 20 as string), '.pgn') as source_file",
        "concat('E', cast(l_partkey % 10 as string)) as event",
        "case when l_partkey % 7 = 0 then '?' else concat('S', cast(l_partkey % 7 as string)) end as site",
        "case when l_partkey % 6 = 0 then '????.??.??' else '2024.01.15' end as date",
        "case when l_partkey % 5 = 0 then '-' else cast(l_partkey % 5 as string) end as round",
        "case l_partkey % 4 when 0 then '1-0' when 1 then '0-1' when 2 then '1/2-1/2' else '*' end as result",
        "case when l_partkey % 9 = 0 then '' else cast(1000 + (l_partkey * 7 + side * 31) % 1500 as string) end"
        " as player_elo",
        "case when l_partkey % 9 = 0 then '' else cast(1000 + (l_partkey * 7 + (1 - side) * 31) % 1500 as string)"
        " end as opponent_elo",
    ]
    return base.selectExpr(*[c for c in columns if c.split()[-1] not in keep], *keep)


def engine_lines(plies_df: DataFrame, ranks: int = 5, *, keys: Sequence[str] = ("physical_game_id", "ply_number")) -> DataFrame:
    """Candidate lines of every ply but one in 29.

    ``ranks`` lines at depth 15 before the move, a depth-1 line on used plies and one
    line after the move. Row-local, so a hot match stays spread.
    """
    line = (
        "named_struct('side', '{side}', 'depth', {depth}, 'pv_rank', {rank}, 'uci', {uci}, 'cp', {cp},"
        " 'mate', {mate}, 'mate_sign', {sign})"
    )
    no_loss = "centipawn_loss is null"
    mate = f"cast(case when {no_loss} then 1 + cents % 5 end as int)"
    sign = f"case when {no_loss} then 1 end"
    before = [
        line.format(
            side="before",
            depth=15,
            rank=k,
            uci=f"concat('m', cast((cents + {k - 1}) % 7 as string))",
            cp=f"cast(case when {no_loss} then null when player_color = 'White'"
            f" then eval_before - {k - 1} * (cents % 41) else eval_before + {k - 1} * (cents % 41) end as int)",
            mate=mate,
            sign=sign,
        )
        for k in range(1, ranks + 1)
    ]
    shallow = line.format(
        side="before", depth=1, rank=1, uci="move_stockfish_1",
        cp=f"cast(case when {no_loss} then null else eval_before end as int)", mate=mate, sign=sign,
    )
    after = line.format(
        side="after", depth=15, rank=1, uci="cast(null as string)",
        cp="cast(eval_after as int)", mate=mate, sign=sign,
    )
    return (
        plies_df.filter("cents % 29 <> 0")
        .selectExpr(
            *keys,
            f"explode(array({', '.join([*before, shallow, after])})) as line",
        )
        .select(*keys, "line.*")
        .filter("uci is not null or side = 'after'")
    )


def scored(plies_df: DataFrame) -> DataFrame:
    """One row per player-game with label ``y`` and two deterministic scores with ties."""
    label = F.max(F.col("is_cheating_player_game").cast("int"))
    total = F.coalesce(F.sum("centipawn_loss"), F.lit(0))
    return plies_df.groupBy("game_id", "physical_game_id").agg(
        label.alias("y"),
        ((total % 81 + 20 * label) / F.lit(100.0)).alias("p"),
        ((total % 61 + 40 * label) / F.lit(100.0)).alias("p_other"),
    )
