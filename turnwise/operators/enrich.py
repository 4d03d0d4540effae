"""Engine evaluations joined to plies.

The lines table holds candidate lines per position; :func:`positions` reduces it to one
row each, :func:`enrich` and :func:`merge_scored` join those rows to the plies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import moves as M

KEYS = ("game_id", "ply_number")

#: A column of plies and lines that are dealt out by stretches of a game, and the most plies in a stretch. What is
#: totalled per game is one row per stretch and task then, and a long game is still spread over tasks.
RUN, RUN_PLIES = "__run", 64


def run_of(ply: str = "ply_number", plies: int = RUN_PLIES) -> Column:
    """Stretch of a ply."""
    return F.expr(f"cast(({ply} - 1) div {plies} as int)")


def run_keys(keys: Sequence[str]) -> list[str]:
    """``keys`` with the stretch ahead of the ply number."""
    return [*keys[:-1], RUN, keys[-1]]


def positions(lines: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per position: its candidate lines at the final depth, and the score after the move.

    What a position shows are greatest values of its lines; only the candidate moves, at most one per
    legal move and depth, are gathered, so any number of ranks takes part.
    """
    keys = list(keys)
    if "san" not in lines.columns:
        lines = lines.withColumn("san", F.lit(None).cast("string"))
    if "mate_sign" not in lines.columns:
        lines = lines.withColumn("mate_sign", F.signum("mate").cast("int"))
    before, rank, score = F.col("side") == "before", F.col("pv_rank"), F.struct("cp", "mate", "mate_sign").alias("score")

    def at_rank(k: int) -> Column:
        """The deepest line of a rank."""
        return F.max(F.when(before & (rank == k), F.struct("depth", "uci", "san", score)))

    candidate = F.struct(F.col("depth"), rank.alias("rank"), F.col("uci"))
    gathered = lines.groupBy(*keys).agg(
        F.max(F.when(before, F.col("depth"))).alias("final_depth"), at_rank(1).alias("line1"), at_rank(2).alias("line2"),
        F.collect_list(F.when(before & F.col("uci").isNotNull(), candidate)).alias("candidates"),
        F.max(F.when(F.col("side") == "after", F.struct("depth", score))).alias("__after"),
        F.max(F.when(before & (rank == 1) & (F.col("depth") == 1), F.col("uci"))).alias("depth1_uci"),
    )
    return gathered.select(
        *keys, "final_depth", "line1", "line2", F.filter("candidates", lambda x: x["depth"] == F.col("final_depth")).alias("moves"),
        F.col("__after.score").alias("after"), "depth1_uci",
    )


def _engine_columns(played: str, color: str) -> dict[str, Column]:
    """Engine columns of a ply beside its position row."""
    best, second, after = F.col("line1.score"), F.col("line2.score"), F.col("after")
    rank = F.array_min(F.transform(F.filter("moves", lambda m: m["uci"] == F.col(played)), lambda m: m["rank"]))
    analysed = F.col("final_depth").isNotNull()
    return {
        "engine_best_move_uci": F.col("line1.uci"),
        "engine_best_move_san": F.col("line1.san"),
        "engine_best_move_depth1": F.col("depth1_uci"),
        "played_move_rank_top5": rank,
        "is_engine_top1": F.when(analysed, F.coalesce((rank == 1).cast("int"), F.lit(0))),
        "is_engine_top3": F.when(analysed, F.coalesce((rank <= 3).cast("int"), F.lit(0))),
        "centipawn_loss": M.centipawn_loss(best["cp"], after["cp"], color).cast("int"),
        "best_vs_second_cp_gap": F.abs(best["cp"] - second["cp"]).cast("int"),
        "engine_score_before": best,
        "engine_score_after": after,
    }


def join_positions(
    plies: DataFrame,
    position_table: DataFrame,
    how: str,
    *,
    keys: Sequence[str] = KEYS,
    played: str = "uci",
    color: str = "player_color",
) -> DataFrame:
    """Plies beside their engine columns, which replace ply columns of the same name.

    The ply number is part of the join key, or the stretch of plies where it is a key: a long game spreads over tasks.
    """
    keys = list(keys)
    engine = _engine_columns(played, color)
    kept = [c for c in plies.columns if c not in engine]
    join = _join_runs if RUN in keys else _join_plies
    joined = join(plies.select(*kept), position_table, how, keys)
    return joined.select(*kept, *[c.alias(n) for n, c in engine.items()], F.col("final_depth").isNotNull().alias("__has_row"))


def _join_plies(plies: DataFrame, position_table: DataFrame, how: str, keys: list[str]) -> DataFrame:
    return plies.join(position_table, keys, how)


def _join_runs(plies: DataFrame, position_table: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """The same rows; the positions of a stretch, a few dozen at most, meet its plies as one array.

    Spark joins rows where they are only if they are dealt out by all the keys of the join.
    """
    *where, ply = keys
    found = [c for c in position_table.columns if c not in keys]
    # positions of sorted lines come sorted, so this sort is none, but lets them be gathered without a map of all stretches
    runs = gather_runs(position_table, keys, "__positions")
    place = F.array_position(F.col("__positions")[ply], F.col(ply)) - 1
    joined = plies.join(runs, where, how).withColumn("__position", F.get("__positions", place.cast("int")))
    if how == "inner":
        joined = joined.filter(F.col("__position").isNotNull())
    return joined.select(*plies.columns, *[F.col("__position")[c].alias(c) for c in found])


def gather_runs(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of a table that is dealt out by stretches as one array per stretch."""
    *where, ply = keys
    found = [c for c in table.columns if c not in keys]
    return table.sortWithinPartitions(*keys).groupBy(*where).agg(F.collect_list(F.struct(ply, *found)).alias(name))


def spread_runs(plies: DataFrame, name: str, ply: str = "ply_number") -> DataFrame:
    """Every ply beside each row of its stretch's array that has its number, or none: a left join that is under way.

    The fields of the rows replace columns of plies.
    """
    found = [f.name for f in plies.schema[name].dataType.elementType.fields if f.name != ply]
    kept = [c for c in plies.columns if c != name and c not in found]
    own = F.filter(name, lambda x: x[ply] == F.col(ply))
    beside = plies.select(*kept, F.explode_outer(own).alias("__row"))
    return beside.select(*kept, *[F.col("__row")[c].alias(c) for c in found])


def _joined(plies: DataFrame, lines: DataFrame, how: str, keys: Sequence[str], played: str) -> DataFrame:
    """``join_positions`` by stretches if both tables are dealt out by them."""
    if RUN in plies.columns and RUN in lines.columns:
        keys = run_keys(keys)
    return join_positions(plies, positions(lines, keys=keys), how, keys=keys, played=played).drop(RUN)


def enrich(plies: DataFrame, lines: DataFrame, *, keys: Sequence[str] = KEYS, played: str = "uci") -> DataFrame:
    """Plies with engine columns; plies without candidate lines count as missing."""
    joined = _joined(plies, lines, "left", keys, played)
    before, after = F.col("engine_score_before"), F.col("engine_score_after")
    mate = before["mate"].isNotNull() | after["mate"].isNotNull()
    has_score = mate | before["cp"].isNotNull() | after["cp"].isNotNull()
    return (
        joined.withColumn("is_forced_mate", F.when(F.col("__has_row"), mate.cast("int")))
        .withColumn("is_engine_eval_missing", (~(F.col("__has_row") & has_score)).cast("int"))
        .withColumn(
            "move_quality",
            M.move_quality(
                F.col("centipawn_loss"),
                F.col("is_engine_top1"),
                F.col("is_forced_mate"),
                F.col("is_engine_eval_missing") == 1,
            ),
        )
        .drop("__has_row")
    )


def merge_scored(plies: DataFrame, lines: DataFrame, *, keys: Sequence[str] = KEYS, played: str = "uci") -> DataFrame:
    """Only the plies that have candidate lines, with their engine columns."""
    return _joined(plies, lines, "inner", keys, played).drop("__has_row")


def with_score_text(df: DataFrame) -> DataFrame:
    """Text form of the score structs, as the published move table has them."""
    return df.withColumn(
        "engine_score_before_cp", M.score_text(F.col("engine_score_before"))
    ).withColumn("engine_score_after_cp", M.score_text(F.col("engine_score_after")))
