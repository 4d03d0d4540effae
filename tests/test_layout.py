"""Layout of the shared steps: what is dealt out, sorted and joined; and the columns that stand for scores."""

from pyspark.sql import functions as F
import pytest

from turnwise.functions import gametext
from turnwise.operators.enrich import RUN, enrich, merge_scored, run_of
from turnwise.operators.ordering import number_rows
from turnwise.queries import REGISTRY, learning, registry
from turnwise.queries.registry import engine_rows
from turnwise.session import tune

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As on tables too large for Spark to broadcast on its own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbering_deals_its_rows_out_once(no_broadcast):
    df = no_broadcast.range(100).selectExpr("id % 3 as k", "id")
    assert "SortMergeJoin" not in _plan(number_rows(df, ["k"], ["id"], "n", spread="id", hot_rows=10))


def test_null_pieces_of_a_hot_key_come_first(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, 5, 3), (1, 6, 4), (None, 5, 5)], "k int, day int, id int")
    out = number_rows(df, ["k"], ["day", "id"], "n", spread="day", hot_rows=2)
    assert {r.id: r.n for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_lines_are_read_position_by_position(no_broadcast):
    """No map of all positions, and one sort of the lines."""
    plan = _plan(engine_rows(tune(no_broadcast), FOLDER).select("physical_game_id", "ply_number", "played_move_rank_top5"))
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning(physical_game_id") == 2


@pytest.mark.parametrize("name, columns", [
    ("lr_oof", ["is_probability"]), ("rf_oof", ["is_probability"]), ("holdout_eval", ["measures_fit", "ranks"]),
    ("ablation_grid", ["measures_fit", "ranks"]), ("score_players", ["class_fits", "scores_sum", "card_fits", "experimental_fits"]),
])
def test_model_queries_state_what_their_scores_must_meet(name, columns):
    assert all(f"true as {c}" in REGISTRY[name].sql for c in columns)


def test_checked_metrics_show_a_measure_out_of_place(spark):
    row = "'m' as model, 1L as tn, 1L as fp, 1L as fn, 1L as tp, 0.5D as accuracy, 0.5D as precision, 0.5D as recall, 0.5D as f1_score"
    good = spark.sql(f"select {row}, 0.5D as roc_auc, 0.5D as pr_auc")
    for table, want in ((good, (True, True)), (good.withColumn("accuracy", F.lit(0.25)), (False, True)),
                        (good.withColumn("roc_auc", F.lit(0.1)), (True, False)), (good.withColumn("pr_auc", F.lit(1.5)), (False, True))):
        assert tuple(learning._checked_metrics(table).select("measures_fit", "ranks").first()) == want


def test_a_record_is_searched_for_tags_once_per_part(spark):
    plan = _plan(spark.sql("select 'x' as record from range(1)").repartition(1).select(gametext.headers("record")))
    assert plan.count("regexp_extract_all(") == 2


@pytest.mark.parametrize("view", [registry.enriched, registry.engine_rows])
def test_tasks_of_the_engine_join_follow_the_plies(spark, tmp_path, monkeypatch, view):
    """Small plies in one task would mean seven times as many lines to sort in it."""
    items = spark.range(3000).selectExpr(
        "id % 50 as l_partkey", "cast('2024-01-01' as timestamp_ntz) as l_shipdate", "id as l_orderkey", "1 as l_linenumber",
        "1 as l_suppkey", "cast(id % 9 as double) as l_quantity", "'A' as l_returnflag", "id * 7.13d as l_extendedprice")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(registry, "POSITION_ROWS", 100, raising=False)
    tasks = view(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 30 and max(r["count"] for r in tasks) < 200


def _items(spark, path, rows, parts):
    spark.range(rows).selectExpr(
        f"id % {parts} as l_partkey", "cast('2024-01-01' as timestamp_ntz) as l_shipdate", "id as l_orderkey", "1 as l_linenumber",
        "1 as l_suppkey", "cast(id % 9 as double) as l_quantity", "'A' as l_returnflag", "id * 7.13d as l_extendedprice",
    ).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_plies_are_dealt_out_as_line_items(no_broadcast):
    """No column that a ply's numbers give passes a shuffle, and none follows the two that deal out."""
    plan = _plan(registry.enriched(no_broadcast, FOLDER))
    dealt = plan.split("Exchange hashpartitioning(physical_game_id")[1:]
    assert len(dealt) == 2
    for below in dealt:
        project = below.splitlines()[1]
        assert "l_partkey" in project and not any(name in project for name in ("player_elo", "opponent_id", "centipawn_loss", "move_player"))


def test_plies_of_a_match_are_totalled_where_they_are(spark, tmp_path, monkeypatch):
    """A match of one stretch is in one task; a longer one is spread."""
    folder = _items(spark, tmp_path, 4000, 40)
    monkeypatch.setattr(registry, "POSITION_ROWS", 64 << 10)
    monkeypatch.setattr(registry, "position_tasks", lambda spark, folder: 16)
    task = F.spark_partition_id().alias("task")
    rows = registry.enriched(spark, folder).select("physical_game_id", (F.col("ply_number") > 64).alias("late"), task).distinct().collect()
    assert len(rows) == 80 and len({r.task for r in rows}) > 4
    assert len({(r.physical_game_id, r.task) for r in rows}) > 60


def test_positions_of_a_stretch_meet_their_plies(spark):
    """As by ply, with plies that come twice, have no lines, or lie under a null key."""
    plies = spark.createDataFrame(
        [("g", n, "White", "a") for n in (1, 2, 2, 64, 65, 70)] + [("h", 1, "Black", "b"), (None, 1, "White", "a")],
        "game_id string, ply_number int, player_color string, uci string")
    lines = spark.createDataFrame(
        [(g, n, side, 9, 1, "a" if side == "before" else None, n + (side == "before"), None)
         for g, n in (("g", 2), ("g", 64), ("g", 65), ("g", 66), ("h", 2), (None, 1)) for side in ("before", "after")],
        "game_id string, ply_number int, side string, depth int, pv_rank int, uci string, cp int, mate int")
    runs = [df.withColumn(RUN, run_of()) for df in (plies, lines)]
    for join, rows in ((enrich, 8), (merge_scored, 4)):
        want = join(plies, lines)
        got = join(*runs)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == rows
