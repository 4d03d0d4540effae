"""Per-ply expressions: perspective, phase, move flags, scores, losses, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.numeric import as_column

# Fixed values shared with the published profile definitions.
OPENING_ABOVE_PIECES = 12
ENDGAME_BELOW_PIECES = 6
LOSS_CAP = 2000
EVAL_CLAMP = 1000.0
WIN_CURVE_SLOPE = 0.00368208
DECISION_PLY = 21
CRITICAL_EVAL = 200
EXCELLENT_MAX, GOOD_MAX, INACCURACY_MAX, MISTAKE_MAX = 25, 50, 100, 200
PHASES = ("Opening", "Middlegame", "Endgame")


def color_of_ply(ply: Column | str) -> Column:
    return F.when(as_column(ply) % 2 == 1, "White").otherwise("Black")


def fullmove_of_ply(ply: Column | str) -> Column:
    return F.floor((as_column(ply) + 1) / 2).cast("int")


def color_from_fen(fen: Column | str) -> Column:
    return F.when(F.split_part(as_column(fen), F.lit(" "), F.lit(2)) == "b", "Black").otherwise("White")


def fullmove_from_fen(fen: Column | str) -> Column:
    return F.split_part(as_column(fen), F.lit(" "), F.lit(6)).try_cast("int")


def by_color(color: Column | str, white: Column | str, black: Column | str) -> Column:
    return F.when(as_column(color) == "White", as_column(white)).otherwise(as_column(black))


def piece_count(fen: Column | str) -> Column:
    """Knights, bishops, rooks and queens of both sides in a FEN placement."""
    placement = F.split_part(as_column(fen), F.lit(" "), F.lit(1))
    return F.length(F.regexp_replace(placement, "[^nbrqNBRQ]", ""))


def game_phase(fen: Column | str) -> Column:
    pieces = piece_count(fen)
    return (
        F.when(pieces > OPENING_ABOVE_PIECES, "Opening")
        .when(pieces < ENDGAME_BELOW_PIECES, "Endgame")
        .when(pieces.isNotNull(), "Middlegame")
    )


def san_flags(san: Column | str) -> dict[str, Column]:
    """0/1 flags read off the move text.

    A check is seen only if the text carries ``+`` or ``#``; records that leave the
    suffix out read 0.
    """
    san = as_column(san)
    return {
        "is_capture": san.contains("x").cast("int"),
        "is_check": san.rlike("[+#][!?]*$").cast("int"),
        "is_promotion": san.rlike("=?[QRBN][+#]?[!?]*$").cast("int")
        * san.rlike("^[a-h]").cast("int"),
    }


def fen_flags(fen: Column | str, uci: Column | str) -> dict[str, Column]:
    """Capture and promotion flags from the position before the move and its UCI text."""
    fen, uci = as_column(fen), as_column(uci)
    board = F.regexp_replace(F.split_part(fen, F.lit(" "), F.lit(1)), "/", "")
    for n in range(8, 0, -1):
        board = F.regexp_replace(board, str(n), "." * n)

    def square(at: int) -> Column:
        text = F.substring(uci, at, 2)
        column = F.ascii(text) - F.lit(ord("a"))
        row = F.lit(8) - F.substring(text, 2, 1).cast("int")
        return F.substr(board, row * 8 + column + 1, F.lit(1))

    en_passant = (F.lower(square(1)) == "p") & (
        F.substring(uci, 3, 2) == F.split_part(fen, F.lit(" "), F.lit(4))
    )
    # the king takes its own rook in the 960 form of castling: not a capture
    own = (F.upper(square(1)) == square(1)) == (F.upper(square(3)) == square(3))
    return {
        "is_capture": (((square(3) != ".") & ~own) | en_passant).cast("int"),
        "is_promotion": (F.length(uci) == 5).cast("int"),
    }


def parse_score(text: Column | str) -> Column:
    """Split ``12`` / ``#+3`` / ``#-0`` into a struct of cp, mate and mate_sign."""
    text = as_column(text).cast("string")
    is_mate = text.startswith("#")
    return F.struct(
        F.when(~is_mate, text.try_cast("int")).alias("cp"),
        F.when(is_mate, F.regexp_extract(text, r"^#[+-](\d+)$", 1).try_cast("int")).alias("mate"),
        F.when(is_mate, F.when(text.startswith("#-"), -1).otherwise(1)).alias("mate_sign"),
    )


def score_text(score: Column) -> Column:
    """Inverse of :func:`parse_score`."""
    mate = F.concat(
        F.when(score["mate_sign"] < 0, "#-").otherwise("#+"), F.abs(score["mate"]).cast("string")
    )
    return F.when(score["mate"].isNotNull(), mate).otherwise(score["cp"].cast("string"))


def engine_score_text(cp: Column, mate: Column, white_view: Column) -> Column:
    """Score text from an engine's cp or signed mate distance, turned to white's view.

    A signed mate above 0 gives ``#+N``; 0 and below give ``#-N``.
    """
    signed = F.when(white_view, mate).otherwise(-mate)
    mate_text = F.concat(F.when(signed > 0, "#+").otherwise("#-"), F.abs(signed).cast("string"))
    cp_text = F.when(white_view, cp).otherwise(-cp).cast("string")
    return F.when(mate.isNotNull(), mate_text).otherwise(cp_text)


def terminal_score(san: Column | str, color: Column | str, is_stalemate: Column | None = None) -> Column:
    """Score text after a game-ending move: mate by the mover, or 0 for a flagged stalemate."""
    mate = F.when(as_column(color) == "White", "#+0").otherwise("#-0")
    out = F.when(as_column(san).rlike("#[!?]*$"), mate)
    return out if is_stalemate is None else out.when(is_stalemate, "0")


def centipawn_loss(before: Column, after: Column, color: Column | str) -> Column:
    """Loss of the mover in [0, 2000]; scores in white's view, NULL where either is mate."""
    diff = F.when(as_column(color) == "White", before - after).otherwise(after - before)
    return F.when(diff.isNotNull(), F.least(F.greatest(diff, F.lit(0)), F.lit(LOSS_CAP)))


def win_probability(evaluation: Column) -> Column:
    clamped = F.least(F.greatest(evaluation.cast("double"), F.lit(-EVAL_CLAMP)), F.lit(EVAL_CLAMP))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-WIN_CURVE_SLOPE) * clamped))


def win_prob_loss(before: Column | str, after: Column | str) -> Column:
    """Drop in win probability, never below 0, of evaluations in the mover's view."""
    before, after = as_column(before), as_column(after)
    drop = win_probability(before) - win_probability(after)
    return F.when(
        before.isNotNull() & after.isNotNull(), F.greatest(drop, F.lit(0.0))
    )


def mover_view(score: Column | str, color: Column | str) -> Column:
    """White-view score seen by the mover."""
    score = as_column(score)
    return F.when(F.lower(as_column(color)) == "white", score).otherwise(-score)


def match_id(game_id: Column | str) -> Column:
    return F.regexp_replace(as_column(game_id).cast("string"), "_[wb]$", "")


def move_quality(loss: Column, top1: Column, forced_mate: Column, missing: Column) -> Column:
    """Quality tier; a top-1 move is "Best" whatever its loss."""
    unscored = missing | loss.isNull()
    return (
        F.when(unscored & (forced_mate == 1), "Forced Mate")
        .when(unscored, F.lit(None))
        .when((loss == 0) | (top1 == 1), "Best")
        .when(loss <= EXCELLENT_MAX, "Excellent")
        .when(loss <= GOOD_MAX, "Good")
        .when(loss <= INACCURACY_MAX, "Inaccuracy")
        .when(loss <= MISTAKE_MAX, "Mistake")
        .otherwise("Blunder")
    )


def player_result(result: Column | str, color: Column | str) -> Column:
    result, white = as_column(result), as_column(color) == "White"
    return (
        F.when(result == "1-0", F.when(white, "win").otherwise("loss"))
        .when(result == "0-1", F.when(white, "loss").otherwise("win"))
        .when(result == "1/2-1/2", "draw")
        .otherwise("unknown")
    )
