"""Exploration and audit tables on literal rows."""

import math

from pyspark.sql import functions as F

from turnwise.operators import audit, cohort, explore


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, None), (2, 3, "y"), (1, 4, "z")], "k int, a int, b string")
    got = [tuple(r) for r in audit.missing_report(df).collect()]
    assert got == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert audit.duplicate_rows(df, ["k"]).first()[0] == 2
    assert audit.duplicate_rows(df.limit(0), ["k"]).first()[0] == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (5,), (10,), (None,)], "x int")
    got = {r.bin: (r.left_edge, r.right_edge, r.rows) for r in explore.histogram(df, "x", 2).collect()}
    assert got == {0: (0.0, 5.0, 3), 1: (5.0, 10.0, 2)}
    flat = explore.histogram(spark.createDataFrame([(3,), (3,)], "x int"), "x", 4).collect()
    assert sum(r.rows for r in flat) == 2


def test_loss_histogram_range(spark):
    rows = [("White", 0), ("White", 20), ("Black", 10)]
    got = explore.loss_histogram(spark.createDataFrame(rows, "player_color string, centipawn_loss int")).collect()
    assert {round(r.right_edge - r.left_edge, 9) for r in got} == {round(50 / 14, 9)}
    big = explore.loss_histogram(spark.createDataFrame(rows + [("Black", 900), ("Black", 300)], "player_color string, centipawn_loss int"))
    assert sum(r.rows for r in big.collect()) == 4  # 900 lies outside, 300 on the closed right edge


def test_outliers_and_boxplot(spark):
    rows = [("a", i, x) for i, x in enumerate([1, 2, 3, 4, 5, 100])] + [("b", 9, None), ("b", 10, 7)]
    df = spark.createDataFrame(rows, "g string, ply int, x int")
    only = df.filter("g = 'a'")
    assert [r.x for r in explore.outliers(only, "x").collect()] == [100]
    assert [r.ply for r in explore.first_outliers(only, 5, value="x", order=["g", "ply"]).collect()] == [5]
    got = {r.g: tuple(r)[1:] for r in explore.boxplot(df, "g", "x").collect()}
    assert got == {"a": (2.25, 3.5, 4.75, 1, 5, 1), "b": (7.0, 7.0, 7.0, 7, 7, 0)}


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 4, 1), (3, 6, 0), (None, 9, 5)], "a int, b int, c int")
    got = {(r.feature_a, r.feature_b): r["corr"] for r in explore.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and abs(got["a", "b"] - 1) < 1e-12 and abs(got["c", "a"] + 1) < 1e-12 and got["a", "c"] == got["c", "a"]


def test_rank_distribution(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (3,)], "played_move_rank_top5 int")
    assert [tuple(r) for r in explore.rank_distribution(df).collect()] == [("1", 2), ("3", 1), ("Unranked (>5)", 1)]


def test_side_by_side_and_breakdown(spark):
    df = spark.createDataFrame(
        [("g", "White", 0.5, None, 0.1, 0.2, 0.3), ("g", "black", 0.25, 0.125, 0.0, 0.0, 0.0)],
        "game_id string, player_color string, top1_match_rate double, excellent_rate double, inaccuracy_rate double,"
        " mistake_rate double, blunder_rate double",
    )
    got = {r.feature: (r.white, r.black) for r in explore.side_by_side(df, ["top1_match_rate", "excellent_rate"]).collect()}
    assert got == {"top1_match_rate": (0.5, 0.25), "excellent_rate": (None, 0.125)}
    broken = {r.category: (r.white_pct, r.black_pct) for r in explore.quality_breakdown(df).collect()}
    assert broken["Excellent (<=25 cp)"] == (0.0, 12.5) and broken["Top-1 Engine Match"] == (50.0, 25.0)


def test_rollup_and_summary(spark):
    df = spark.createDataFrame([("A", "f", 3), ("A", "f", 2), ("B", "g", 4)], "source_category string, source_file string, moves int")
    got = {(r.level, r.source_category, r.source_file): (r.games, r.moves) for r in audit.file_rollup(df).collect()}
    assert got["total", None, None] == (3, 9) and got["category", "A", None] == (2, 5) and got["file", "B", "g"] == (1, 4)
    summary = {r.source_category: tuple(r)[1:] for r in audit.category_summary(df, ["A", "C"]).collect()}
    assert summary == {"A": (1, 2, 5), "C": (0, 0, 0)}


def test_provenance(spark, values):
    rows = [("Human\\Immortal_Game.PGN",), ("x/opera_game_1858.pgn",), ("y.pgn",)]
    got = values(rows, "p string", audit.provenance("p")["provenance_status"])
    assert got == ["verified_historical_human", "verified_historical_human", "unverified_user_input"]
    counts = {tuple(r) for r in audit.provenance_counts(spark.createDataFrame(rows, "p string"), "p").collect()}
    assert counts == {("verified_historical_human", 2), ("unverified_user_input", 1)}


def test_audit_takes_first_present_label(spark):
    rows = [("a_w", 2, "p", True, True, False), ("a_w", 1, "p", False, None, None), ("a_b", 1, "q", True, False, True)]
    df = spark.createDataFrame(rows, "game_id string, half_move int, player_id string, is_used boolean,"
                                     " is_cheating_player_game boolean, is_cheating_move boolean")
    r = audit.dataset_audit(df).first()
    assert (r.total_move_rows, r.total_player_games, r.unique_physical_matches, r.unique_players) == (3, 2, 1, 2)
    assert (r.used_decision_points, r.cheating_moves, r.cheating_games, r.fair_games) == (2, 1, 1, 1)


def test_score_parts_add_up(spark):
    df = spark.createDataFrame([("g", 2.0, None)], "k string, a double, b double")
    rows = cohort.score_contributions(df, ["k"], {"a": 0.5, "b": 2.0}, {"a": 1.0, "b": 0.0}, {"a": 2.0, "b": 1.0}, -0.25).collect()
    parts = {r.feature: r.contribution for r in rows}
    assert parts == {"a": 0.25, "b": 0.0} and rows[0].log_odds == 0.0 and rows[0].probability == 0.5


def test_cohort_distance(spark):
    rows = [("r1", 0, 1.0), ("r2", 0, 3.0), ("r3", 1, 10.0), ("r4", 1, 14.0), ("r5", 1, 12.0)]
    df = spark.createDataFrame(rows, "k string, y int, x double")
    got = {r.k: (r.z0, r.z1) for r in cohort.cohort_distance(df, ["k"], "y", ["x"]).collect()}
    assert math.isclose(got["r1"][0], -1 / math.sqrt(2)) and math.isclose(got["r4"][1], 1.0)
    assert df.filter(F.col("y") > 5).count() == 0
