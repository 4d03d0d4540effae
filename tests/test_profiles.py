"""Engine rows, profiles and features on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from turnwise.operators import report
from turnwise.operators.enrich import enrich, merge_scored, positions, with_score_text
from turnwise.operators.features import benchmark_features, engine_features
from turnwise.operators.profile import loss_stats, profile

LINES = "game_id int, ply_number int, side string, depth int, pv_rank int, uci string, san string, cp int, mate int, mate_sign int"


def _lines(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], LINES)


def _enriched(spark, plies, lines, join=enrich):
    df = spark.createDataFrame([(1, *p) for p in plies], "game_id int, ply_number int, player_color string, uci string")
    return {r.ply_number: r for r in join(df, _lines(spark, *lines)).collect()}


def before(ply, rank, uci, cp=None, mate=None, depth=15):
    return (ply, "before", depth, rank, uci, uci, cp, mate, None if mate is None else 1)


def after(ply, cp=None, mate=None, depth=15, sign=1):
    return (ply, "after", depth, 1, None, None, cp, mate, None if mate is None else sign)


def test_candidate_rank_gap_and_depths(spark):
    ranked = [before(1, i, u, 200 - 50 * (i - 1)) for i, u in enumerate(["e2e4", "d2d4", "g1f3", "c2c4", "b2b3"], 1)]
    lines = [
        *ranked, before(1, 1, "g1f3", 10, depth=1), before(1, 1, "b2b3", 5, depth=9), after(1, 120, depth=14), after(1, 100),
        before(2, 1, "e7e5", 30), after(2, 50),
        before(3, 1, "d2d4", None, 3), before(3, 2, "c2c4", 100), after(3, None, 2),
    ]
    got = _enriched(spark, [(1, "White", "g1f3"), (2, "Black", "d7d5"), (3, "White", "c2c4"), (4, "Black", "a7a6")], lines)
    r = got[1]
    assert (r.engine_best_move_uci, r.engine_best_move_depth1, r.played_move_rank_top5) == ("e2e4", "g1f3", 3)
    assert (r.is_engine_top1, r.is_engine_top3, r.best_vs_second_cp_gap, r.centipawn_loss) == (0, 1, 50, 100)
    assert (r.is_forced_mate, r.is_engine_eval_missing, r.move_quality) == (0, 0, "Inaccuracy")
    r = got[2]
    assert (r.played_move_rank_top5, r.is_engine_top1, r.is_engine_top3, r.best_vs_second_cp_gap, r.centipawn_loss) == (None, 0, 0, None, 20)
    assert r.engine_best_move_depth1 is None
    r = got[3]
    assert (r.centipawn_loss, r.best_vs_second_cp_gap, r.is_forced_mate, r.move_quality) == (None, None, 1, "Forced Mate")
    assert (r.played_move_rank_top5, r.is_engine_top3) == (2, 1)
    r = got[4]
    assert (r.engine_best_move_uci, r.is_engine_top1, r.is_forced_mate, r.is_engine_eval_missing, r.move_quality) == (None, None, None, 1, None)


def test_inner_merge_keeps_analysed_plies(spark):
    got = _enriched(spark, [(1, "White", "e2e4"), (2, "Black", "e7e5")], [before(1, 1, "e2e4", 20), after(1, 15)], merge_scored)
    assert list(got) == [1] and got[1].centipawn_loss == 5


def test_rank_needs_the_final_depth(spark):
    lines = [before(1, 1, "e2e4", 20), before(1, 2, "d2d4", 10, depth=3)]
    assert _enriched(spark, [(1, "White", "d2d4")], lines)[1].played_move_rank_top5 is None


def test_score_text_columns(spark):
    plies = spark.createDataFrame([(1, 1, "White", "e2e4")], "game_id int, ply_number int, player_color string, uci string")
    lines = _lines(spark, before(1, 1, "e2e4", 12), after(1, None, 0, sign=-1))
    row = with_score_text(enrich(plies, lines)).first()
    assert (row.engine_score_before_cp, row.engine_score_after_cp) == ("12", "#-0")
    assert positions(lines).count() == 1


def test_loss_stats(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("b", None), ("c", 25)], "k string, x int")
    got = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*loss_stats(F.col("x"))).collect()}
    assert got == {"a": (20.0, 20.0, 10.0, 10, 30), "b": (None,) * 5, "c": (25.0, 25.0, 0.0, 25, 25)}


PROFILE_IN = (
    "game_id int, ply_number int, player_color string, game_phase string, centipawn_loss int, is_engine_top1 int,"
    " is_engine_top3 int, is_forced_mate int, is_engine_eval_missing int, is_capture int, is_check int, is_promotion int, event string, result string"
)


def _profile(spark, rows, **kw):
    df = spark.createDataFrame(rows, PROFILE_IN)
    return {r.player_color: r for r in profile(df, context=["event", "result"], **kw).collect()}


def test_profile_of_four_plies(spark):
    got = _profile(spark, [
        (1, 1, "White", "Opening", 0, 1, 1, 0, 0, 0, 0, 0, "E", "1-0"), (1, 2, "Black", "Opening", 30, 0, 1, 0, 0, 0, 0, 0, "E", "1-0"),
        (1, 3, "White", "Opening", 10, 1, 1, 0, 0, 0, 0, 0, "late", "1-0"), (1, 4, "Black", "Middlegame", 250, 0, 0, 0, 0, 1, 1, None, "E", "1-0"),
    ])
    w, b = got["White"], got["Black"]
    assert (w.scored_moves, w.mean_centipawn_loss, w.top1_match_rate, w.player_result, w.event) == (2, 5.0, 1.0, "win", "E")
    assert (b.mean_centipawn_loss, b.blunder_count, b.blunder_rate, b.player_result) == (140.0, 1, 0.5, "loss")
    assert (b.captures_count, b.checks_count, b.promotions_count, b.inaccuracy_count, b.mistake_count) == (1, 1, 0, 0, 0)
    assert (b.opening_moves, b.middlegame_scored_moves, b.endgame_moves, b.endgame_mean_cp_loss, b.endgame_top1_rate) == (1, 1, 0, None, None)


def test_rates_may_pass_one_unless_strict(spark):
    rows = [
        (1, 1, "White", "Endgame", 3, 1, 1, 0, 0, 0, 0, 0, "E", "*"), (1, 3, "White", "Endgame", None, 1, 1, 1, 0, 0, 0, 0, "E", "*"),
        (1, 5, "White", None, None, None, None, None, 1, 0, 0, 0, "E", "*"),
    ]
    loose, strict = _profile(spark, rows)["White"], _profile(spark, rows, strict_rates=True)["White"]
    assert (loose.top1_match_rate, loose.endgame_top1_rate, loose.mate_eval_moves, loose.missing_eval_count) == (2.0, 2.0, 1, 1)
    assert (strict.top1_match_rate, strict.top3_match_rate) == (1.0, 1.0)
    assert loose.player_result == "unknown" and loose.total_moves == 3 and loose.std_centipawn_loss == 0.0
    assert _profile(spark, rows, rounded=True)["White"].missing_eval_rate == 0.3333


def test_profile_without_scored_plies(spark):
    row = _profile(spark, [(1, 1, "White", "Opening", None, None, None, None, 1, 0, 0, 0, "E", "0-1")])["White"]
    assert row.mean_centipawn_loss is None and row.top1_match_rate is None and row.missing_eval_rate == 1.0
    assert row.player_result == "loss"


ENGINE_IN = (
    "game_id int, ply_number int, player_color string, uci string, centipawn_loss int, is_engine_top1 int,"
    " engine_best_move_uci string, engine_best_move_depth1 string, before int, after int"
)


def _engine(spark, rows, **kw):
    df = spark.createDataFrame([(1, *r) for r in rows], ENGINE_IN)
    df = df.withColumns({f"engine_score_{s}": F.struct(F.col(s).alias("cp")) for s in ("before", "after")})
    return {r.player_color: r for r in engine_features(df, **kw).collect()}


def test_engine_features(spark):
    got = _engine(spark, [
        (1, "White", "e2e4", 0, 1, "e2e4", None, 20, 20), (2, "Black", "e7e5", 15, 0, "c7c5", None, 20, 35),
        (21, "White", "a2a3", 20, 1, "a2a3", None, 20, 0), (22, "Black", "b7b6", 240, 0, "c7c6", None, 0, 240),
    ])
    w, b = got["White"], got["Black"]
    assert (w.move_count, w.mean_centipawn_loss, w.top1_match_rate, w.used_mean_cp_loss) == (2, 10.0, 1.0, 20.0)
    assert (b.move_count, b.blunder_rate, b.used_blunder_rate, b.top1_match_rate) == (2, 0.5, 1.0, 0.0)
    p = lambda e: 1 / (1 + math.exp(-0.00368208 * e))
    assert b.mean_norm_cp_loss == pytest.approx((p(-20) - p(-35) + p(0) - p(-240)) / 2)
    assert w.std_centipawn_loss == 10.0


def test_short_game_uses_all_plies_but_not_for_complexity(spark):
    got = _engine(spark, [
        (1, "White", "e2e4", 0, 1, "e2e4", "e2e4", 20, 20), (3, "White", "d2d4", 150, None, "c2c4", "c2c4", 0, -150),
    ], complexity=True)["White"]
    assert (got.top1_match_rate, got.used_mean_cp_loss, got.used_blunder_rate) == (0.5, 75.0, 0.5)
    assert got.stable_top1_match_rate is None and got.critical_mean_cp_loss is None


def test_complexity_from_engine_rows(spark):
    got = _engine(spark, [
        (22, "White", "e2e4", 10, 1, "e2e4", "e2e4", 50, 40), (24, "White", "h2h3", 80, 0, "d2d4", "c2c4", 120, 40),
        (26, "White", "h2h4", 80, 0, "d2d4", None, 500, 40),
    ], complexity=True)["White"]
    assert (got.critical_top1_match_rate, got.critical_mean_cp_loss) == (0.5, 45.0)
    assert (got.stable_top1_match_rate, got.unstable_top1_match_rate, got.depth_drop_rate) == (1.0, 0.0, 1.0)


def test_complexity_pools_three_plies(spark):
    got = _engine(spark, [
        (22, "Black", "e7e5", 5, 1, "e7e5", "e7e5", 0, 5), (24, "Black", "d7d5", 5, 1, "d7d5", "a7a6", 0, 5),
        (26, "Black", "h7h6", 5, 0, "d7d6", "a7a6", 0, 5),
    ], complexity=True)["Black"]
    assert (got.stable_top1_match_rate, got.unstable_top1_match_rate, got.depth_drop_rate) == (1.0, 0.5, 0.5)


BENCH_IN = (
    "game_id string, half_move int, player_id string, player_color string, is_used boolean, is_cheating_player_game boolean,"
    " centipawn_loss int, normalized_centipawn_loss double, move_player string, move_stockfish_1 string, move_stockfish_15 string, eval_before int"
)


def test_benchmark_features(spark):
    rows = [
        ("m_w", 1, "p1", "White", False, True, 300, 0.5, "e2e4", None, None, 0),
        ("m_w", 21, "p1", "White", True, True, 20, 0.1, "e2e4", "e2e4", "e2e4", 10),
        ("m_w", 23, "p1", "White", True, True, None, None, "g1f3", "d2d4", "g1f3", 300),
        ("n_b", 2, "p2", "Black", False, False, 40, 0.2, "e7e5", None, None, 0),
    ]
    got = {r.game_id: r for r in benchmark_features(spark.createDataFrame(rows, BENCH_IN), complexity=True).collect()}
    m, n = got["m_w"], got["n_b"]
    assert (m.physical_game_id, m.player_id, m.is_cheating, m.move_count) == ("m", "p1", 1, 3)
    assert (m.mean_centipawn_loss, m.std_centipawn_loss, m.blunder_rate, m.excellent_rate) == (160.0, 140.0, 0.5, 0.5)
    assert (m.top1_match_rate, m.used_mean_cp_loss, m.used_blunder_rate) == (1.0, 20.0, 0.0)
    assert (m.stable_top1_match_rate, m.unstable_top1_match_rate, m.depth_drop_rate) == (1.0, 1.0, 0.0)
    assert (m.critical_top1_match_rate, m.critical_mean_cp_loss) == (1.0, 20.0)
    assert (n.top1_match_rate, n.used_mean_cp_loss, n.std_centipawn_loss, n.mean_norm_cp_loss) == (None, None, 0.0, 0.2)


def test_missing_best_move_counts_as_unstable(spark):
    rows = [("m_w", 21, "p1", "White", True, True, 20, 0.1, "e2e4", None, "e2e4", 10)]
    got = benchmark_features(spark.createDataFrame(rows, BENCH_IN), complexity=True).first()
    assert (got.unstable_top1_match_rate, got.stable_top1_match_rate) == (1.0, None)


def test_cards(spark):
    df = report.classify(spark.createDataFrame([(0.724,), (0.142,), (0.5,)], "p double"))
    card = report.player_card("classification", "engine_assisted_likelihood", "human_like_likelihood")
    got = [r.c for r in df.select("p", card.alias("c")).orderBy(F.desc("p")).collect()]
    assert [(round(c.primary_pct, 6), round(c.secondary_pct, 6), c.badge_text) for c in got] == [
        (72.4, 27.6, "ENGINE-ASSISTED"), (50.0, 50.0, "ENGINE-ASSISTED"), (85.8, 14.2, "HUMAN-LIKE")
    ]
    assert got[2].primary_label == report.HUMAN_LABEL and got[2].secondary_label == report.ASSIST_LABEL


def test_depth_gate(spark):
    df = spark.createDataFrame([(15, 0.61234), (10, 0.7)], "depth int, p double")
    got = [tuple(r)[2:] for r in report.depth_gate(df, "p", "depth").orderBy(F.desc("depth")).collect()]
    assert got == [(True, "compatible", 15, 0.6123, "engine-assisted"), (False, "incompatible_depth", 15, None, None)]
    loose = report.depth_gate(df, "p", "depth", require=False).filter("depth = 10").first()
    assert (loose.status, loose.score) == ("unverified_depth", 0.7)


def test_display_and_aliases(spark, values):
    assert values([(0.1234,), (None,), (float("nan"),)], "x double", report.display_value("x", "blunder_rate"),
                  report.display_value("x", "mean_loss")) == [("12.3%", "0.12"), ("N/A", "N/A"), ("N/A", "N/A")]
    # ties go to the even digit of the binary value, whole numbers show as they are
    assert values([(0.0625, 6), (0.0635, None)], "x double, n int", report.display_value("x", "top1_match_rate"),
                  report.display_value("x", "mean_loss"), report.display_value("n", "move_count")) == [
        ("6.2%", "0.06", "6"), ("6.3%", "0.06", "N/A")]
    assert values([(0.125,), (-2.675,)], "x double", report.display_value("x", "mean_loss")) == ["0.12", "-2.67"]
    df = spark.createDataFrame([("White", 3)], "player string, ply_number int")
    assert report.alias_both_ways(df).columns == ["player", "ply_number", "player_color", "ply"]
