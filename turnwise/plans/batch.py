"""Game-record folders to move table, player profiles and manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import audit
from turnwise.operators.enrich import RUN, RUN_PLIES, enrich, gather_runs, run_keys, run_of, spread_runs, with_score_text
from turnwise.operators.profile import profile
from turnwise.schemas import (
    BASE_PLY_COLUMNS,
    CATEGORIES,
    ENGINE_COLUMNS,
    ENGINE_LINES,
    MOVE_COLUMNS,
    PROFILE_COLUMNS,
)
from turnwise.session import materialise
from turnwise.sources import games as G
from turnwise.sources import sinks

#: Columns only a rules engine can add; they join from an optional position table.
POSITION_COLUMNS = {"uci": "string", "fen_before": "string", "legal_moves_count": "int", "game_phase": "string"}
VERSION = "2.0.0"
#: Plies in a task of the joins and in a file of the move table, if the caller names no number of tasks.
TASK_PLIES, FILE_PLIES = 1 << 15, 1 << 14
NO_RECORDS = "no parseable game found"
UNREAD = "file could not be read to its end"
# Names of the published provenance totals, and the published remark.
PROVENANCE_TOTALS = {
    "verified_historical_games": "verified_historical_human",
    "illustrative_unverified_engine_games": "illustrative_engine_demonstration_unverified",
    "synthetic_demonstration_games": "synthetic_programmatic_demonstration",
}
READINESS = (
    "Demonstration pipeline only. Not suitable for training machine learning models or claiming human/AI"
    " discrimination without ingesting a verified, balanced research corpus."
)


@dataclass(frozen=True)
class BatchResult:
    moves: DataFrame
    profiles: DataFrame
    rejects: DataFrame
    files: DataFrame
    manifest: DataFrame


def run(
    spark: SparkSession,
    root: str,
    *,
    positions: DataFrame | None = None,
    lines: DataFrame | None = None,
    categories: Sequence[str] = CATEGORIES,
    max_games_per_file: int | None = None,
    engine_name: str | None = None,
    tasks: int | None = None,
) -> BatchResult:
    """Build all tables of a batch.

    ``positions`` adds per-ply board columns and ``lines`` engine candidate lines, both
    keyed by (source_file, game_index, ply_number). Without lines every ply counts as
    not evaluated. Games are dealt out to ``tasks`` before they become plies, in stretches, and both tables
    with them, unless they come with a column ``RUN`` and are dealt out so already. Parsed games and enriched
    moves are written once each, since several outputs read them. A file that can't be read to its end is one reject, without any of its
    games; the others' games stay. Files are read once, and their texts enter no shuffle.
    """
    listed = G.list_categories(spark, root, categories)
    records = G.parse_records(G.scan_category_pieces(spark, root, categories))
    has_record = F.col("record").isNotNull().alias("__record")
    pieces = materialise(records.select("*", has_record).drop("record", "mainline"), "pieces")
    unread = G.unread_files(pieces, listed)
    whole = pieces.filter("__record").join(unread, "source_file", "left_anti")
    parsed = materialise(G.number_games(whole).drop("file", "__record"), "games")
    good = G.good_games(parsed)
    if max_games_per_file:
        good = G.first_n_per_file(good, max_games_per_file)
    numbered = G.with_game_ids(good, categories)
    key = ["source_file", "game_index", "ply_number"]
    game = key[:-1]
    if tasks is None:
        found = good.agg(F.sum(F.size("moves"))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-found // TASK_PLIES))

    def dealt(table: DataFrame) -> DataFrame:
        return table if RUN in table.columns else table.withColumn(RUN, run_of()).repartition(tasks, *game, RUN)

    cut = G.cut_games(numbered, RUN_PLIES, RUN).repartition(tasks, *game, RUN)
    carried = ["game_id", "source_category", *game, RUN]
    if positions is not None:
        # joined to stretches, which are far fewer than plies and need sorting
        cut = cut.join(gather_runs(dealt(positions), run_keys(key), "__positions"), [*game, RUN], "left")
        carried.append("__positions")
    plies = G.explode_plies(cut, carried, ahead=F.col(RUN) * RUN_PLIES)
    if positions is not None:
        plies = spread_runs(plies, "__positions")
    for name, kind in POSITION_COLUMNS.items():
        if name not in plies.columns:
            plies = plies.withColumn(name, F.lit(None).cast(kind))
    with_engine = lines is not None
    if with_engine:
        lines = dealt(lines)
    else:
        fields = [f for f in ENGINE_LINES.fields if f.name not in ("game_id", "ply_number")]
        lines = plies.limit(0).select(
            *key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        )
    moves = materialise(with_score_text(enrich(plies, lines, keys=key)).select(
        "game_index", *MOVE_COLUMNS, "engine_best_move_depth1"
    ), "moves", rows_per_file=FILE_PLIES)
    profiles = profile(moves, rounded=True).select(*PROFILE_COLUMNS)
    seen = parsed.select("source_file", "source_category").distinct()
    silent = listed.drop("size").join(seen, "source_file", "left_anti").join(unread, "source_file", "left_anti")
    bad = G.rejects(parsed, ["source_file", "source_category", "game_index"]).unionByName(
        silent.withColumn("error", F.lit(NO_RECORDS)).unionByName(unread.withColumn("error", F.lit(UNREAD))),
        allowMissingColumns=True,
    )
    per_file = moves.groupBy("source_file").agg(
        F.count_distinct("game_id").alias("games_processed"), F.count(F.lit(1)).alias("moves_extracted")
    )
    zero = F.lit(0).cast("bigint")
    files = seen.join(per_file, "source_file", "left").select(
        F.col("source_file").alias("file"), F.col("source_category").alias("category"),
        F.coalesce("games_processed", zero).alias("games_processed"),
        F.coalesce("moves_extracted", zero).alias("moves_extracted"),
        audit.provenance("source_file").alias("provenance_audit"),
    )
    depth = lines.agg(F.max("depth")).first()[0] if with_engine else None
    document = manifest(files, profiles, listed, categories, engine=with_engine, engine_name=engine_name, depth=depth)
    return BatchResult(moves, profiles, bad, files, document)


def manifest(files: DataFrame, profiles: DataFrame, listed: DataFrame, categories: Sequence[str] = CATEGORIES, *,
             engine: bool = False, engine_name: str | None = None, depth: int | None = None,
             outputs: dict[str, str] | None = None) -> DataFrame:
    """Totals per category and provenance status, in one row of nested columns.

    Lists of files and rejects are tables of their own: they grow with the data.
    """
    def rows(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    def total(name: str, among=None):
        value = F.col(name) if among is None else F.when(among, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0))

    per_category = [
        F.struct(
            F.count_if(F.col("category") == c).alias("files"),
            total("games_processed", F.col("category") == c).alias("games"),
            total("moves_extracted", F.col("category") == c).alias("moves"),
        ).alias(c)
        for c in categories
    ]
    status = F.col("provenance_audit.provenance_status")
    by_status = [F.count_if(status == s).alias(name) for name, s in PROVENANCE_TOTALS.items()]
    by_status.append(F.lit(READINESS).alias("research_readiness"))
    return files.agg(
        F.struct(
            total("games_processed").alias("total_games_processed"),
            total("moves_extracted").alias("total_moves_extracted"),
            F.struct(*per_category).alias("categories"),
        ).alias("summary"),
        F.struct(*by_status).alias("provenance_audit_summary"),
    ).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.lit(VERSION).alias("pipeline_version"),
        F.struct(
            F.lit(engine).alias("enabled"), F.lit(engine_name).cast("string").alias("engine_name"),
            F.lit(depth).cast("int").alias("depth"),
        ).alias("engine_info"),
        F.col("summary").withField("total_files_scanned", rows(listed)).withField(
            "total_player_games", rows(profiles)
        ).alias("summary"),
        "provenance_audit_summary",
        F.struct(*[F.lit(path).alias(n) for n, path in (outputs or {"move_level_csv": None}).items()]).alias("outputs"),
    )


def write(result: BatchResult, output: str, *, compression: str = "none") -> None:
    """Write the CSV tables (moves, profiles, base plies and their enriched copy), the manifest document and
    its file and reject lists.

    The tags of a game stand in each of its plies in three of the tables; ``compression`` (such as gzip) of
    the CSV files saves that room, and readers tell it from their names.
    """
    def table(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
        sinks.write_csv(rows, path, columns, compression=compression)

    table(result.moves, f"{output}/move_level_features", MOVE_COLUMNS)
    base = f"{output}/base_features"
    table(result.moves, base, BASE_PLY_COLUMNS)
    table(result.moves, sinks.engine_output_path(base), [*BASE_PLY_COLUMNS, *ENGINE_COLUMNS])
    table(result.profiles, f"{output}/player_game_features", PROFILE_COLUMNS)
    paths = {"move_level_csv": f"{output}/move_level_features", "player_game_csv": f"{output}/player_game_features"}
    named = F.struct(*[F.lit(path).alias(n) for n, path in paths.items()])
    sinks.write_document(result.manifest.withColumn("outputs", named), f"{output}/dataset_manifest")
    sinks.write_document(result.files, f"{output}/files_processed")
    sinks.write_document(result.rejects, f"{output}/skipped_and_errors")
