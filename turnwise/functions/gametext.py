"""Game-record text as columns: headers, main line, clocks, reject reasons.

Everything is regular expressions over one record, so a scan of game text needs no
shuffle to become plies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.numeric import as_column

# Patterns of the game-record grammar.
HEADER = r'(?m)(?=\[)^\[[ \t]*([A-Za-z0-9_]+)[ \t]+"([^"\\]*+(?:\\.[^"\\]*+)*+)"[ \t]*\][ \t\r]*$'
SAN = (
    r"(?:O-O-O|O-O|0-0-0|0-0|[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|[a-h]x[a-h][1-8](?:=?[QRBN])?"
    r"|[a-h][1-8](?:=?[QRBN])?)[+#]?[!?]*"
)
CLOCK = r"\{[^}]*\[%clk\s+([0-9:.]+)\][^}]*\}"
_HEADER_LINE = r'^\[[ \t]*[A-Za-z0-9_]+[ \t]+"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t]*\][ \t\r]*$'
# the look-ahead lets the matcher skip ordinary characters with one test each
_NOT_MOVES = rf"(?m)(?=[{{;%\[$])(?:{CLOCK}|\{{[^}}]*\}}|;.*$|^%.*$|{_HEADER_LINE}|\$\d+)"
REJECT_EMPTY = "empty text"
REJECT_NO_MOVES = "no mainline moves"
REJECT_UNBALANCED = "unbalanced variation"
REJECT_TOKEN = "unreadable move token"


def headers(record: Column | str) -> Column:
    """Header map of a record; of a repeated tag the last value counts."""
    record = as_column(record)
    names = F.regexp_extract_all(record, F.lit(HEADER), F.lit(1))
    values = F.regexp_extract_all(record, F.lit(HEADER), F.lit(2))

    def entries(pairs: Column) -> Column:
        last = F.filter(
            pairs, lambda pair, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda later: later["key"] == pair["key"])
        )
        return F.transform(
            last, lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(p["value"], r"\\(.)", "$1").alias("value"))
        )

    return F.map_from_entries(once(F.arrays_zip(names.alias("key"), values.alias("value")), entries))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def header(header_map: Column | str, tag: str) -> Column:
    """Header value, NULL where absent or a placeholder."""
    return known_value(F.element_at(as_column(header_map), F.lit(tag)))


def known_value(value: Column | str) -> Column:
    """NULL for ``""``, ``-`` and texts of only ``?`` once ``.`` and ``-`` are dropped."""
    value = as_column(value)
    bare = F.regexp_replace(value, r"[.\-]", "")
    return F.when(~(value.isin("", "-") | bare.rlike(r"^\?+$")), value)


def mainline(record: Column | str) -> Column:
    """Main line of a record with each clock comment turned into ``<h:mm:ss>``.

    One pass drops comments, headers and marks from left to right and keeps clocks. A pass in
    time linear in the text then drops variations of up to ``LEVELS`` levels, and only what nests deeper
    gets more such passes, or is walked piece by piece at last. The last pass drops move numbers, results and the empty clocks
    the first one leaves. A text whose parentheses don't balance
    keeps one, by which :func:`reject_reason` knows it.
    """
    text = F.regexp_replace(as_column(record), _NOT_MOVES, " <$1> ")
    flat = F.regexp_replace(text, _VARIATION, " ")

    def deeper(t: Column) -> Column:
        for _ in range(PASSES):
            t = F.regexp_replace(t, _VARIATION, " ")
        return once(t, lambda rest: F.when(rest.rlike("[()]"), _outside_variations(rest)).otherwise(rest))

    flat = once(flat, lambda t: F.when(t.rlike("[()]"), deeper(t)).otherwise(t))
    return F.trim(F.regexp_replace(flat, _NUMBERS, " "))


#: Levels of variations that a pass drops, and passes before what nests deeper still is walked.
LEVELS, PASSES = 6, 6


def _variation(levels: int) -> str:
    """A variation of at most so many levels; possessive throughout, so no text is read again for a shorter match."""
    inner = r"\([^()]*+\)"
    for _ in range(levels - 1):
        inner = rf"\((?:[^()]++|{inner})*+\)"
    return inner


_VARIATION = _variation(LEVELS)


def _outside_variations(text: Column) -> Column:
    """Text at depth 0, whatever the depth of the variations between.

    The text is cut at parentheses; a running depth over the pieces tells which stay.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"([()]|[^()]+)"), F.lit(1))
    step = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"), F.array().cast("array<string>").alias("kept"))

    def walk(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)
        outside = (depth == 0) & ~piece.isin("(", ")")
        return F.struct(
            depth.alias("depth"), F.least(a["least"], depth).alias("least"),
            F.when(outside, F.array_append(a["kept"], piece)).otherwise(a["kept"]).alias("kept"),
        )

    return F.aggregate(
        pieces, step, walk,
        lambda a: F.when((a["depth"] == 0) & (a["least"] == 0), F.array_join(a["kept"], " ")).otherwise(F.lit("(")),
    )


_NUMBERS = r"(?=[0-9*<])(?:(?:^|(?<=\s))(?:(?:1-0|0-1|1/2-1/2|\*)(?=\s|$)|\d+\s*\.+)|<>)"


def moves(line: Column | str) -> Column:
    """Array of (san, clock) of a main line, in order."""
    line = as_column(line)
    pattern = F.lit(rf"(?:^|(?<=\s))({SAN})(?=\s|$)(?:\s+<([0-9:.]+)>)?")
    return F.arrays_zip(
        F.transform(
            F.regexp_extract_all(line, pattern, F.lit(1)),
            lambda san: F.regexp_replace(san, "[!?]+$", ""),
        ).alias("san"),
        F.regexp_extract_all(line, pattern, F.lit(2)).alias("clock"),
    )


def reject_reason(record: Column | str, line: Column | str, move_array: Column | str) -> Column:
    """Why a record is not a usable game, NULL for a good one."""
    record, line = as_column(record), as_column(line)
    rest = F.regexp_replace(line, r"<[0-9:.]+>", " ")
    rest = F.regexp_replace(rest, rf"(?:^|(?<=\s)){SAN}(?=\s|$)", " ")
    return (
        F.when(record.isNull() | (F.trim(record) == ""), REJECT_EMPTY)
        .when(line.rlike(r"[()]"), REJECT_UNBALANCED)
        .when(rest.rlike(r"\S"), REJECT_TOKEN)
        .when(F.size(as_column(move_array)) == 0, REJECT_NO_MOVES)
    )


def clock_seconds(clock: Column | str) -> Column:
    """``h:mm:ss(.f)`` as seconds rounded to one decimal; NULL where there is none."""
    parts = F.split(as_column(clock), ":")
    total = (
        parts.getItem(0).try_cast("double") * 3600
        + F.get(parts, F.lit(1)).try_cast("double") * 60
        + F.get(parts, F.lit(2)).try_cast("double")
    )
    return F.round(total, 1)


# Messages of the published check.
MSG_EMPTY = "PGN content is empty. Please provide a valid PGN string or file."
MSG_NO_GAME = "No valid chess game found in the provided PGN text."
MSG_NO_MOVES = "The PGN game contains headers but no mainline moves. Cannot compute features."
MSG_VALID = "Valid PGN game with mainline moves."


def check_text(text: Column | str) -> Column:
    """Lenient check of a text column: struct of is_valid and message.

    The first main-line token decides: a text opening with anything but a move has
    no main line. Legality is not checked.
    """
    text = as_column(text)
    blank = text.isNull() | ~text.rlike(r"\S")
    no_game = ~F.regexp_replace(text, r"(?m)^[%;].*$", "").rlike(r"\S")
    # any move holds a square or a castling mark; texts without one skip the clean-up
    may_move = text.rlike("[a-h][1-8]|[O0]-[O0]")
    has_move = may_move & mainline(text).rlike(rf"^\s*(?:<[0-9:.]+>\s+)*{SAN}(?:\s|$)")
    message = (
        F.when(blank, MSG_EMPTY)
        .when(no_game, MSG_NO_GAME)
        .when(has_move, MSG_VALID)
        .otherwise(MSG_NO_MOVES)
    )
    # bound to a lambda variable so that both fields share one evaluation
    both = F.transform(
        F.array(message), lambda m: F.struct((m == MSG_VALID).alias("is_valid"), m.alias("message"))
    )
    return F.get(both, F.lit(0))
