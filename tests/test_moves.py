"""Per-ply expressions on literal rows."""

import math

from pyspark.sql import functions as F

from turnwise.functions import moves as M


def test_centipawn_loss(values):
    rows = [(200, 50, "White"), (200, 198, "White"), (-100, 50, "Black"), (-150, -148, "Black"),
            (3000, -3000, "White"), (50, 100, "White"), (None, 100, "White"), (100, None, "Black")]
    got = values(rows, "b int, a int, c string", M.centipawn_loss(F.col("b"), F.col("a"), "c"))
    assert got == [150, 2, 150, 2, 2000, 0, None, None]


def test_loss_is_missing_next_to_a_mate(values):
    rows = [("#+3", "100"), ("100", "#-2"), ("#+1", "#-1")]
    before, after = M.parse_score("b")["cp"], M.parse_score("a")["cp"]
    assert values(rows, "b string, a string", M.centipawn_loss(before, after, F.lit("White"))) == [None] * 3


def test_score_text_round_trip(values):
    rows = [("150",), ("-100",), ("#+2",), ("#-3",), ("#+0",), ("#-0",), ("",), (None,)]
    s = M.parse_score("t")
    got = values(rows, "t string", s["cp"], s["mate"], s["mate_sign"], M.score_text(s))
    assert got == [
        (150, None, None, "150"), (-100, None, None, "-100"), (None, 2, 1, "#+2"), (None, 3, -1, "#-3"),
        (None, 0, 1, "#+0"), (None, 0, -1, "#-0"), (None, None, None, None), (None, None, None, None),
    ]


def test_engine_score_text(values):
    rows = [(150, None, True), (100, None, False), (None, 2, True), (None, -3, True), (None, 0, True)]
    got = values(rows, "cp int, mate int, w boolean", M.engine_score_text(F.col("cp"), F.col("mate"), F.col("w")))
    assert got == ["150", "-100", "#+2", "#-3", "#-0"]


def test_terminal_score(values):
    rows = [("Qf7#", "White", False), ("Qh4#", "Black", False), ("Kf7", "White", True), ("e4", "White", False)]
    got = values(rows, "s string, c string, stale boolean", M.terminal_score("s", "c", F.col("stale")))
    assert got == ["#+0", "#-0", "0", None]


def test_move_quality(values):
    rows = [(0, 1, 0, False), (5, 1, 0, False), (15, 0, 0, False), (35, 0, 0, False), (75, 0, 0, False),
            (150, 0, 0, False), (350, 0, 0, False), (None, 0, 1, False), (None, 0, 0, True), (None, 0, 1, True),
            (25, 0, 0, False), (26, 0, 0, False), (100, 0, 0, False), (101, 0, 0, False), (201, 0, 0, False)]
    got = values(rows, "l int, t int, m int, x boolean", M.move_quality(F.col("l"), F.col("t"), F.col("m"), F.col("x")))
    assert got == ["Best", "Best", "Excellent", "Good", "Inaccuracy", "Mistake", "Blunder", "Forced Mate", None,
                   "Forced Mate", "Excellent", "Good", "Inaccuracy", "Mistake", "Blunder"]


def test_win_prob_loss(values):
    rows = [(100, 100), (500, 0), (0, 500), (5000, 1000), (None, 3)]
    got = values(rows, "b int, a int", M.win_prob_loss("b", "a"))
    expected = 1 / (1 + math.exp(-0.00368208 * 500)) - 0.5
    assert got[0] == 0 and abs(got[1] - expected) < 1e-12 and got[2] == 0 and got[3] == 0 and got[4] is None


def test_match_id(values):
    rows = [("01zsFrq4_w",), ("01zsFrq4_b",), ("game123",), ("a_w_b",), ("a_W",)]
    assert values(rows, "g string", M.match_id("g")) == ["01zsFrq4", "01zsFrq4", "game123", "a_w", "a_W"]


def test_phase_counts_pieces_only(values):
    rows = [
        ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",),
        ("r1bqk2r/8/8/8/8/8/8/R1BQKB1R w - - 0 3",),
        ("rnbqk1nr/8/8/8/8/8/8/R1BQKBNR w - - 0 3",),
        ("rnbqk1nr/8/8/8/8/8/8/RNBQKBNR w - - 0 3",),
        ("r1bqk3/8/8/8/8/8/8/R1BQK3 w - - 0 3",),
        ("r3k2r/8/8/8/8/8/8/R2QK2R w - - 0 3",),
        ("4k3/8/8/8/8/8/8/RNB1KBN1 w - - 0 3",),
        ("4k3/8/8/8/8/8/PPPPPPPP/RNBQK3 w - - 0 3",),
        (None,),
    ]
    got = values(rows, "f string", M.piece_count("f"), M.game_phase("f"))
    assert got == [(14, "Opening"), (9, "Middlegame"), (12, "Middlegame"), (13, "Opening"),
                   (6, "Middlegame"), (5, "Endgame"), (5, "Endgame"), (4, "Endgame"), (None, None)]


def test_san_flags(values):
    flags = M.san_flags("s")
    rows = [("e4",), ("exd5",), ("Qh5#",), ("e8=Q+",), ("bxa1=N",), ("O-O",), ("Nf3!",), ("Rxe8+!?",)]
    got = values(rows, "s string", flags["is_capture"], flags["is_check"], flags["is_promotion"])
    assert got == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 1), (1, 0, 1), (0, 0, 0), (0, 0, 0), (1, 1, 0)]


def test_fen_flags(values):
    flags = M.fen_flags("f", "u")
    rows = [
        ("rnbqkbnr/ppp1pppp/8/3p4/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2", "e4d5"),
        ("rnbqkbnr/ppp1pppp/8/3p4/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2", "g1f3"),
        ("rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w KQkq f6 0 3", "e5f6"),
        ("8/P7/8/8/8/8/8/k6K w - - 0 1", "a7a8q"),
        ("1n6/P7/8/8/8/8/8/k6K w - - 0 1", "a7b8n"),
    ]
    got = values(rows, "f string, u string", flags["is_capture"], flags["is_promotion"])
    assert got == [(1, 0), (0, 0), (1, 0), (0, 1), (1, 1)]


def test_player_result(values):
    rows = [("1-0", "White"), ("1-0", "Black"), ("0-1", "White"), ("0-1", "Black"), ("1/2-1/2", "White"), ("*", "White"), (None, "Black")]
    assert values(rows, "r string, c string", M.player_result("r", "c")) == [
        "win", "loss", "loss", "win", "draw", "unknown", "unknown"
    ]
