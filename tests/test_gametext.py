"""Game-record files and texts."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import gametext as G
from turnwise.sources import games

MINIMAL = """[Event "Minimal"]
[Site "Test"]
[Date "2024.01.01"]
[Round "1"]
[White "One"]
[Black "Two"]
[WhiteElo "1500"]
[BlackElo "1480"]
[Result "1/2-1/2"]

1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 1/2-1/2
"""
BARE = '[Event "Bare"]\n[Result "1/2-1/2"]\n\n1. d4 d5 2. c4 c6 3. Nf3 Nf6 1/2-1/2\n'
COMMENTED = """[Event "Comments"]
[White "?"]
[Date "????.??.??"]
[Result "1-0"]

1. e4 { on (e4 } e5 {[%clk 0:09:58.4]} ; rest ( of line
2. Nf3 $1 ( 2. f4 { not main [%clk 0:01:00] } exf4 ( 2... d5 ( 2... d6 ) ) ) 2... Nc6!? {fine [%clk 1:00:05] so}
%ignored line 9. Qxq9
3. Bb5 { idea } a6 4. Ba4 Nf6 1-0
"""
TWO = """[Event "Scholar"]
[White "A"]
[Black "B"]
[Result "1-0"]

1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6 4. Qxf7# 1-0

[Event "Fool"]
[White "C"]
[Black "D"]
[Result "0-1"]

1. f3 e5 2. g4 Qh4# 0-1
"""
NO_MOVES = '[Event "None"]\n[White "A"]\n[Black "B"]\n[Result "*"]\n\n*\n'
MALFORMED = "This is not a game record at all.\nNo headers here.\n"
HISTORIC = """[Event "London"]
[Date "1851.06.21"]
[Result "1-0"]

1. e4 e5 2. f4 exf4 3. Bc4 Qh4+ 4. Kf1 b5 5. Bxb5 Nf6 6. Nf3 Qh6 7. d3 Nh5 8. Nh4 Qg5 9. Nf5 c6 10. g4 Nf6
11. Rg1 cxb5 12. h4 Qg6 13. h5 Qg5 14. Qf3 Ng8 15. Bxf4 Qf6 16. Nc3 Bc5 17. Nd5 Qxb2 18. Bd6 Bxg1 19. e5 Qxa1+
20. Ke2 Na6 21. Nxg7+ Kd8 22. Qf6+ Nxf6 23. Be7# 1-0
"""


def _parse(spark, *texts):
    rows = [("f", i, t) for i, t in enumerate(texts, 1)]
    return games.parse_records(spark.createDataFrame(rows, "file string, game_index int, record string"))


def _plies(spark, *texts):
    return games.explode_plies(games.good_games(_parse(spark, *texts))).orderBy("game_index", "ply_number").collect()


def test_minimal_game(spark):
    rows = _plies(spark, MINIMAL)
    assert [r.san for r in rows] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6", "O-O", "Be7"]
    assert [r.ply_number for r in rows] == list(range(1, 11))
    assert [r.fullmove_number for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r.player_color for r in rows[:3]] == ["White", "Black", "White"]
    white, black = rows[0], rows[1]
    assert (white.player_name, white.player_elo, white.opponent_name, white.opponent_elo) == ("One", "1500", "Two", "1480")
    assert (black.player_name, black.opponent_elo) == ("Two", "1500")
    assert white.clock_seconds is None


def test_missing_headers_are_null(spark):
    rows = _plies(spark, BARE)
    assert len(rows) == 6
    assert (rows[0].event, rows[0].site, rows[0].white_player, rows[0].white_elo) == ("Bare", None, None, None)


def test_comments_variations_and_clocks(spark):
    rows = _plies(spark, COMMENTED)
    assert [r.san for r in rows] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "Ba4", "Nf6"]
    assert [r.clock_seconds for r in rows] == [None, 598.4, None, 3605.0, None, None, None, None]
    assert (rows[0].white_player, rows[0].date) == (None, None)


def test_historic_game(spark):
    rows = _plies(spark, HISTORIC)
    assert len(rows) == 45 and rows[-1].san == "Be7#" and rows[-1].result == "1-0"
    assert sum(r.is_check for r in rows) == 5 and sum(r.is_capture for r in rows) == 9


def test_rejects_carry_a_reason(spark):
    deep = MINIMAL.replace("2. Nf3", "2. Nf3 (x")
    parsed = _parse(spark, MINIMAL, NO_MOVES, MALFORMED, deep, MINIMAL.replace("Nc6", "Zz9"), "  ")
    got = {r.game_index: (r.error, r.white) for r in games.rejects(parsed).collect()}
    assert got == {
        2: (G.REJECT_NO_MOVES, "A"), 3: (G.REJECT_TOKEN, None), 4: (G.REJECT_UNBALANCED, "One"),
        5: (G.REJECT_TOKEN, "One"), 6: (G.REJECT_EMPTY, None),
    }
    assert games.good_games(parsed).count() == 1


def test_repeated_and_escaped_headers(spark):
    text = '[Event "a"]\n[White "x \\"y\\" \\\\z"]\n[Event "b"]\n\n1. e4 *\n'
    row = _parse(spark, text).first()
    assert row.headers == {"White": 'x "y" \\z', "Event": "b"}


def test_long_values_and_variations_do_not_overflow_the_matcher(spark):
    value, aside = "w" * 200_000 + '\\"' * 20_000, "(d5 (d6) )" + " Nf6 (c5)" * 20_000
    rows = _plies(spark, f'[Event "{value}"]\n\n1. e4 ({aside}) {{{"x" * 200_000}}} e5 *\n', "[" + "a " * 100_000)
    assert [r.san for r in rows] == ["e4", "e5"] and len(rows[0].event) == 220_000


def test_known_value(values):
    rows = [("?",), ("??",), ("????.??.??",), ("-",), ("",), ("?-?",), ("2024.??.??",), ("a?",), (None,), (".",)]
    assert values(rows, "v string", G.known_value("v")) == [
        None, None, None, None, None, None, "2024.??.??", "a?", None, "."
    ]


def test_fen_start_with_black_to_move(spark):
    text = '[Event "x"]\n[FEN "8/8/8/8/8/8/8/K6k b - - 0 31"]\n\n31... Kg2 32. Kb2 *\n'
    rows = _plies(spark, text)
    assert [(r.player_color, r.fullmove_number) for r in rows] == [("Black", 31), ("White", 32)]


def test_check_text(values):
    rows = [("",), (" \n ",), (None,), ("% only\n; comments",), (NO_MOVES,), (MALFORMED,), (MINIMAL,), ("1. e4 e5",),
            ("e4 is a fine move",), ("{say} 1. d4",)]
    got = values(rows, "t string", G.check_text("t")["message"])
    assert got == [G.MSG_EMPTY] * 3 + [G.MSG_NO_GAME] + [G.MSG_NO_MOVES] * 2 + [G.MSG_VALID] * 4


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "human_games/b two.PGN": TWO, "human_games/a.pgn": MINIMAL + "\n" + NO_MOVES + "\n" + BARE,
        "unlabeled/z.pgn": "\n\n" + COMMENTED.replace("\n", "\r\n"), "unlabeled/bad.pgn": MALFORMED,
        "unlabeled/notes.txt": MINIMAL, "other/c.pgn": MINIMAL, "unlabeled/deep/d.pgn": MINIMAL,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "unlabeled" / "bytes.pgn").write_bytes(b'\xef\xbb\xbf[Event "caf\xe9"]\n\n1. e4 *\n')
    return str(tmp_path)


def test_category_scan(spark, folder):
    parsed = games.parse_records(games.scan_categories(spark, folder))
    got = sorted((r.source_file, r.game_index, r.reject_reason) for r in parsed.collect())
    assert got == [
        ("human_games/a.pgn", 1, None), ("human_games/a.pgn", 2, G.REJECT_NO_MOVES), ("human_games/a.pgn", 3, None),
        ("human_games/b two.PGN", 1, None), ("human_games/b two.PGN", 2, None),
        ("unlabeled/bad.pgn", 1, G.REJECT_TOKEN), ("unlabeled/bytes.pgn", 1, None), ("unlabeled/z.pgn", 1, None),
    ]
    first = {r.source_file: r.n for r in games.first_games(parsed.withColumn("n", F.size("moves"))).collect()}
    assert first == {"human_games/a.pgn": 10, "human_games/b two.PGN": 7, "unlabeled/bytes.pgn": 1, "unlabeled/z.pgn": 8}
    event = parsed.filter("source_file = 'unlabeled/bytes.pgn'").select(F.element_at("headers", F.lit("Event"))).first()[0]
    assert event == "caf�"


def test_strict_first_game_raises(spark, folder):
    parsed = games.parse_records(games.scan_categories(spark, folder))
    with pytest.raises(Exception, match="unreadable move token"):
        games.first_games(parsed, strict=True).collect()
    with pytest.raises(ValueError, match="no parseable game"):
        games.require_records(parsed.limit(0))


def test_game_ids_run_over_categories_files_and_games(spark, folder):
    good = games.good_games(games.parse_records(games.scan_categories(spark, folder)))
    got = sorted((r.game_id, r.source_file, r.game_index) for r in games.with_game_ids(good).collect())
    assert got == [
        (1, "human_games/a.pgn", 1), (2, "human_games/a.pgn", 3), (3, "human_games/b two.PGN", 1),
        (4, "human_games/b two.PGN", 2), (5, "unlabeled/bytes.pgn", 1), (6, "unlabeled/z.pgn", 1),
    ]
    few = games.first_n_per_file(good, 1)
    assert sorted((r.source_file, r.game_index) for r in few.collect()) == [
        ("human_games/a.pgn", 1), ("human_games/b two.PGN", 1), ("unlabeled/bytes.pgn", 1), ("unlabeled/z.pgn", 1)
    ]


def test_split_file_keeps_its_order(spark, tmp_path):
    """A file cut into many splits and numbered as a hot key gives the games in file order."""
    many = "\n".join(MINIMAL.replace('"Minimal"', f'"G{i}"') for i in range(400))
    (tmp_path / "big.pgn").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        records = games.scan_records(spark, str(tmp_path), hot_rows=50)
        parsed = games.parse_records(records)
        rows = parsed.select("game_index", F.element_at("headers", F.lit("Event")).alias("e"), F.size("moves").alias("n")).collect()
        assert records.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.game_index, r.e) for r in rows) == [(i + 1, f"G{i}") for i in range(400)]
    assert {r.n for r in rows} == {10}


def test_variations_of_any_depth(spark):
    deep = MINIMAL.replace("2. Nf3", "2. Nf3 " + "(a " * 60 + ")" * 60)
    assert [r.san for r in _plies(spark, deep)] == [r.san for r in _plies(spark, MINIMAL)]


def test_unbalanced_parentheses_are_rejected(spark):
    for text in ("2. Nf3 )x(", "2. Nf3 (x", "2. Nf3 x)"):
        parsed = _parse(spark, MINIMAL.replace("2. Nf3", text))
        assert [r.error for r in games.rejects(parsed).collect()] == [G.REJECT_UNBALANCED]


def test_games_without_an_event_tag_stay_apart(spark, tmp_path):
    text = '[Event "A"]\n[White "One"]\n\n1. e4 e5 1-0\n\n[Site "here"]\n[White "Two"]\n\n1. d4 {a\n[b] c} d5 2. c4 0-1\n'
    (tmp_path / "two.pgn").write_text(text + text.replace("[Event", "\n[Event"))
    rows = games.parse_records(games.scan_records(spark, str(tmp_path))).orderBy("game_index").collect()
    assert [(r.game_index, r.headers["White"], [m.san for m in r.moves]) for r in rows] == [
        (1, "One", ["e4", "e5"]), (2, "Two", ["d4", "d5", "c4"]), (3, "One", ["e4", "e5"]), (4, "Two", ["d4", "d5", "c4"]),
    ]


def test_variations_deeper_than_the_passes_and_unbalanced_ones(spark):
    """Depths around the number of passes, also beside each other, give the same line; so do broken ones the same reason."""
    def nested(depth):
        return "(" * depth + "1. a4 " + ") ".join([""] * depth) + ")"

    texts = [f"1. e4 {nested(d)} e5 {nested(1)} 2. Nf3 {nested(2 * d)} *" for d in (1, G.LEVELS - 1, G.LEVELS, G.LEVELS + 1, 40)]
    broken = [f"1. e4 {x} e5 *" for x in ("(a", "a)", ") b (", nested(9) + ")", "(" + nested(9), "((" + nested(3) + ")")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + broken)], "i int, t string")
    rows = df.select("i", G.mainline("t").alias("line")).orderBy("i").collect()
    assert [r.line.split() for r in rows[:len(texts)]] == [["e4", "e5", "Nf3"]] * len(texts)
    assert all("(" in r.line or ")" in r.line for r in rows[len(texts):])
