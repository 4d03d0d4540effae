"""Whole batches over game files, their outputs read back, and values as they are shown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators import report
from turnwise.operators.enrich import RUN, run_keys, run_of
from turnwise.operators.features import benchmark_features
from turnwise.plans import batch
from turnwise.queries.registry import KEYS, array_sql, plies, position_tasks, query
from turnwise.queries.text import MATCHES_SQL, game_files
from turnwise.schemas import BASE_FEATURES, BASE_PLY_COLUMNS, CATEGORIES, ENGINE_COLUMNS
from turnwise.session import materialise, scratch_folder
from turnwise.sources import adapters, tables

#: File names of the batches; four of them have a provenance of their own.
NAMES = ["casual_game", "f1", "f2", "immortal_game", "opera_game_1858", "tcec_engine_game", "f6"]

_PLACED_SQL = f"""(select *, {array_sql(NAMES)}[1 + match % 7] as title from ({MATCHES_SQL}))"""
_STATUS_SQL = {
    "verified_historical_games": "title in ('immortal_game', 'opera_game_1858')",
    "illustrative_unverified_engine_games": "title = 'tcec_engine_game'",
    "synthetic_demonstration_games": "title = 'casual_game'",
}


@query("batch_manifest", f"""
select {', '.join(f"cast({total} as bigint) as {part}_{c}" for k, c in enumerate(CATEGORIES) for part, total in (
    ('files', f'count(distinct title) filter (place = {k})'), ('games', f'count(*) filter (place = {k})'),
    ('moves', f'coalesce(sum(plies) filter (place = {k}), 0)')))},
  count(*) as total_games_processed, cast(sum(plies) as bigint) as total_moves_extracted,
  count(distinct cast(place as varchar) || title) as total_files_scanned,
  cast(sum(case when plies > 1 then 2 else 1 end) as bigint) as total_player_games,
  {', '.join(f"count(distinct cast(place as varchar) || title) filter ({where}) as {name}" for name, where in _STATUS_SQL.items())}
from {_PLACED_SQL}""", ("plies",))
def batch_manifest(spark, folder):
    """Manifest of a batch over game files: totals per category and per provenance."""
    found = batch.run(spark, game_files(spark, folder, NAMES)).manifest
    per_category = [
        F.col(f"summary.categories.{c}.{part}").cast("bigint").alias(f"{part}_{c}")
        for c in CATEGORIES for part in ("files", "games", "moves")
    ]
    totals = ["total_games_processed", "total_moves_extracted", "total_files_scanned", "total_player_games"]
    return found.select(
        *per_category, *[F.col(f"summary.{t}").cast("bigint").alias(t) for t in totals],
        *[F.col(f"provenance_audit_summary.{name}").cast("bigint").alias(name) for name in _STATUS_SQL],
    )


def _tasks(spark, folder) -> int:
    """Twice as many as for the engine join of plies, since file names make the lines twice as wide."""
    return 2 * position_tasks(spark, folder)


def _keyed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Position columns and engine lines of the plies, keyed by file, game and ply, and dealt out by stretches of a game.

    What plies are made of is placed and dealt out; their columns and lines are made behind that.
    """
    items = adapters.numbered_items(spark, folder)
    match = F.col("l_partkey").cast("bigint")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (1 + match % 3).cast("int"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (1 + match % 7).cast("int"))
    file = F.concat(category, F.lit("/"), name, F.lit(".pgn"))
    place = F.row_number().over(Window.partitionBy("source_file").orderBy(match))
    matches = adapters.table(spark, folder, "lineitem").select("l_partkey").distinct()
    games = matches.select("l_partkey", file.alias("source_file")).select("*", place.alias("game_index"))
    where = ["source_file", "game_index", RUN]
    # written once, since positions, lines and the depth of the lines are each read from it
    placed = materialise(items.join(games, "l_partkey").withColumn(RUN, run_of()), "placed", rows_per_file=batch.FILE_PLIES)
    p = adapters.ply_columns(placed.repartition(_tasks(spark, folder), *where), where).withColumn("ply_number", F.col("ply_number").cast("int"))
    key = run_keys(["source_file", "game_index", "ply_number"])
    positions = p.select(*key, F.col("move_player").alias("uci"), "game_phase")
    return positions, adapters.engine_lines(p, keys=key).sortWithinPartitions(*key)


_PLAIN = ["site", "white_player", "player_color", "san", "uci", "game_phase"]
_ENGINE = [c for c in ENGINE_COLUMNS if c != "engine_best_move_san"]


def _output_sql(kind: str) -> str:
    """Rows of one output; the base one has no engine columns."""
    types = {c: "bigint" for c in _ENGINE} | {c: "varchar" for c in _ENGINE if c.endswith("_cp") and c.startswith("engine_score")}
    types |= {c: "varchar" for c in _ENGINE if c.startswith("engine_best")}
    score = lambda side: f"case when {side}_mate is not null then '#+' || cast({side}_mate as varchar) else cast({side}_cp as varchar) end"
    made = {"engine_score_before_cp": score("r.best"), "engine_score_after_cp": score("r.after")}
    engine = [
        f"cast({made.get(c, f'e.{c}') if kind == 'enriched' else 'null'} as {types[c]}) as {c}" for c in _ENGINE
    ]
    return f"""select '{kind}' as output, g.game_id, e.ply_number, case when e.site = '?' then null else e.site end as site,
  'W' || e.physical_game_id as white_player, e.player_color, {array_sql(adapters.SAN_SAMPLES)}[1 + e.cents % 10] as san,
  e.move_player as uci, e.game_phase, {', '.join(engine)}
from enriched e left join engine_rows r using (physical_game_id, ply_number) join (
  select cast(match as varchar) as physical_game_id, row_number() over (order by place, title || '.pgn', match) as game_id
  from {_PLACED_SQL}) g using (physical_game_id)"""


@query("batch_outputs", f"{_output_sql('base')} union all {_output_sql('enriched')}", ("enriched",))
def batch_outputs(spark, folder):
    """Base plies and their enriched copy, written by a batch with positions and engine lines and read back."""
    positions, lines = _keyed(spark, folder)
    result = batch.run(spark, game_files(spark, folder, NAMES), positions=positions, lines=lines, tasks=_tasks(spark, folder))
    root = f"{scratch_folder(spark)}/batch-{uuid.uuid4().hex}"
    batch.write(result, root, compression="gzip")
    base = tables.base_ply_table(spark, f"{root}/base_features").select(F.lit("base").alias("output"), *BASE_PLY_COLUMNS)
    both = base.unionByName(
        tables.engine_ply_table(spark, f"{root}/base_features_engine_analysis").withColumn("output", F.lit("enriched")),
        allowMissingColumns=True,
    )
    whole = ["game_id", "ply_number", *[c for c in _ENGINE if dict(both.dtypes)[c] == "int"]]
    return both.select("output", *whole, *_PLAIN, *[c for c in _ENGINE if c not in whole]).withColumns(
        {c: F.col(c).cast("bigint") for c in whole})


@query("alias_columns", """
select physical_game_id, ply_number, ply_number as ply, player_color, player_color as player from plies""", ("plies",))
def alias_columns(spark, folder):
    """Plies that come with ``ply`` and ``player_color`` get the other name of each as well."""
    given = plies(spark, folder).select("physical_game_id", F.col("ply_number").alias("ply"), "player_color")
    return report.alias_both_ways(given).select(*KEYS, "ply", "player_color", "player")


def _text_sql(name: str) -> str:
    if name == "move_count":
        return f"cast({name} as varchar)"
    return f"printf('%.1f%%', {name} * 100)" if "rate" in name else f"printf('%.2f', {name})"


@query("display_text", " union all ".join(
    f"select game_id, '{c}' as feature, case when {c} is null then 'N/A' else {_text_sql(c)} end as shown from features"
    for c in BASE_FEATURES), ("features",))
def display_text(spark, folder):
    """The features of every player and game as a comparison shows them."""
    features = benchmark_features(plies(spark, folder), order="ply_number")
    cells = [F.struct(F.lit(c).alias("feature"), report.display_value(c, c).alias("shown")) for c in BASE_FEATURES]
    return features.select("game_id", F.inline(F.array(*cells)))
