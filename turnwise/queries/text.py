"""Game-record text: rendered from plies, parsed back, checked against the plies."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import gametext as G
from turnwise.queries.registry import KEYS, array_sql, plies, query, r6, sql_r6
from turnwise.schemas import CATEGORIES
from turnwise.session import scratch_folder
from turnwise.session import materialise
from turnwise.sources import adapters, games
from turnwise.sources.adapters import SAN_SAMPLES, table

#: Plies per rendered record; it bounds every record whatever the length of a match.
BLOCK = 64
_BLOCKED = (
    f"(select *, cast((ply_number - 1)//{BLOCK} as int) as block, cast((ply_number - 1) % {BLOCK} + 1 as int) as ply,"
    f" {array_sql(SAN_SAMPLES)}[1 + cents % 10] as san from plies)"
)
_FAULT = "(cast(physical_game_id as bigint) + block) % 6"
#: Nesting of the variations in the checked texts; the operator knows no bound.
_DEEP = 40
_MESSAGE_NESTING = 8


def records(spark, folder, *, faults: bool = False) -> DataFrame:
    """One text per block of plies of a match, with comments, clocks, variations and marks."""
    san = F.element_at(F.array(*[F.lit(s) for s in SAN_SAMPLES]), (1 + F.col("cents") % 10).cast("int"))
    p = plies(spark, folder).withColumns({
        "san": san,
        "block": F.expr(f"cast((ply_number - 1) div {BLOCK} as int)"),
        "fault": F.expr(f"(cast(physical_game_id as bigint) + (ply_number - 1) div {BLOCK}) % 6"),
    })
    every = lambda n, text: F.when(F.col("cents") % n == 0, text).otherwise("")
    number = F.when(
        F.col("ply_number") % 2 == 1, F.concat(F.expr("cast((ply_number + 1) div 2 as string)"), F.lit(". "))
    ).otherwise("")
    token = F.concat(
        number, "san", every(11, " $1"),
        every(4, F.format_string(" {note (x) [%%clk %d:%02d:%02d.5]}", *[
            F.expr(e) for e in ("cents % 7200 div 3600", "cents % 3600 div 60", "cents % 60")
        ])),
        every(7, " (1. d4 {aside (deep)} d5 (1... Nf6 2. c4) 2. c4 {[%clk 0:00:09]})"),
        every(13, " ; rest ( of } line\n"),
    )
    if faults:
        token = (
            F.when(F.col("fault") == 0, "")
            .when(F.col("fault") == 1, F.concat(token, F.lit(" Zz9")))
            .when(F.col("fault") == 2, F.concat(token, F.lit(" (a")))
            .when(F.col("fault") == 3, F.concat(token, F.lit(" " + "(1. d4 " * _DEEP + "a" + ")" * _DEEP)))
            .when(F.col("fault") == 4, F.concat(token, F.lit(" " + "(" * 9 + "a" + ")" * 9)))
            .otherwise(token)
        )
    tags = {
        "Event": F.col("event"), "Site": F.col("site"), "Date": F.col("date"), "Round": F.col("round"),
        "White": F.concat(F.lit('The \\"'), F.col("physical_game_id"), F.lit('\\" one')),
        "Result": F.col("result"),
    }
    text = games.render_text(p, ["physical_game_id", "block"], token, tags)
    return text.withColumn("record", F.concat("record", F.lit(" *\n")))


def match_records(spark, folder) -> DataFrame:
    """One text per match with all its plies, and the category and file name it goes to."""
    san = F.element_at(F.array(*[F.lit(s) for s in SAN_SAMPLES]), (1 + F.col("cents") % 10).cast("int"))
    # under its own name, by which plies come sorted, a match's texts are gathered without a map of all matches
    p = adapters.plies(spark, folder, keep=["l_partkey"]).withColumns({"san": san, "match": F.col("l_partkey").cast("bigint")})
    token = F.concat("san", F.when(F.col("cents") % 7 == 0, " (1. d4 {aside} (1... d5))").otherwise(""))
    tags = {"Site": F.col("site"), "Date": F.col("date"), "Round": F.col("round"),
            "White": F.concat(F.lit("W"), F.col("physical_game_id")), "Result": F.col("result")}
    return games.render_text(p, ["match"], token, tags)


FILE_NAMES = [f"f{k}" for k in range(7)]


def game_files(spark, folder, names: Sequence[str] = FILE_NAMES) -> str:
    """Root of the matches written as game files into category folders, three times as many as names.

    Half of the games of a file have no Event tag, so records hold several games.
    """
    root = f"{scratch_folder(spark)}/pgn-{uuid.uuid4().hex}"
    event = F.when(F.col("match") % 2 == 0, F.lit('[Event "E"]\n')).otherwise("")
    made = match_records(spark, folder).select(
        "match", F.element_at(F.array(*map(F.lit, CATEGORIES)), (1 + F.col("match") % 3).cast("int")).alias("category"),
        F.element_at(F.array(*map(F.lit, names)), (1 + F.col("match") % len(names)).cast("int")).alias("name"),
        F.concat(event, F.regexp_replace("record", r"\n+$", ""), F.lit(" *\n")).alias("value"),
    )
    games.write_files(made, root, order="match")
    return root


MATCHES_SQL = f"""
  select cast(physical_game_id as bigint) as match, count(*) as plies, cast(physical_game_id as bigint) % 3 as place,
    'f' || cast(cast(physical_game_id as bigint) % 7 as varchar) || '.pgn' as name, site, date, round, result,
    array_to_string(list({array_sql(SAN_SAMPLES)}[1 + cents % 10] order by ply_number), ' ') as sans,
    sum(length({array_sql(SAN_SAMPLES)}[1 + cents % 10]) + 1 + case when cents % 7 = 0 then length(' (1. d4 {{aside}} (1... d5))') else 0 end) as body
  from plies group by physical_game_id, site, date, round, result"""
_FILE_SQL = f"{array_sql(list(CATEGORIES))}[1 + place] || '/' || name as source_file"


@query("pgn_category_scan", f"""
select {_FILE_SQL}, 'W' || cast(match as varchar) as white,
  row_number() over (order by place, name, match) as game_id,
  row_number() over (partition by place, name order by match) as game_index, plies, md5(sans) as sans_md5
from ({MATCHES_SQL})""", ("plies",))
def pgn_category_scan(spark, folder):
    """Game files listed, read, parsed and numbered."""
    parsed = games.parse_records(games.scan_categories(spark, game_files(spark, folder)))
    numbered = games.with_game_ids(games.good_games(parsed))
    return numbered.select(
        "source_file", G.header("headers", "White").alias("white"), F.col("game_id").cast("bigint").alias("game_id"),
        F.col("game_index").cast("bigint").alias("game_index"), F.size("moves").cast("bigint").alias("plies"),
        F.md5(F.array_join("moves.san", " ")).alias("sans_md5"),
    )


@query("pgn_first_game", f"""
select {_FILE_SQL}, case when site = '?' then null else site end as site,
  case when date = '????.??.??' then null else date end as date, case when round = '-' then null else round end as round,
  'W' || cast(match as varchar) as white, plies, md5(sans) as sans_md5
from (select *, row_number() over (partition by place, name order by match) as nth from ({MATCHES_SQL})) where nth = 1""", ("plies",))
def pgn_first_game(spark, folder):
    """The first game of every game file, whole."""
    parsed = games.parse_records(games.scan_categories(spark, game_files(spark, folder)))
    return games.first_games(parsed).select(
        "source_file", *[G.header("headers", t).alias(t.lower()) for t in ("Site", "Date", "Round", "White")],
        F.size("moves").cast("bigint").alias("plies"), F.md5(F.array_join("moves.san", " ")).alias("sans_md5"),
    )


@query("pgn_file_coverage", f"""
select {_FILE_SQL}, cast(sum(size) as bigint) as size, cast(sum(size) as bigint) as bytes_read, count(*) as games, false as unread
from (select *, case when match % 2 = 0 then length('[Event "E"]') + 1 else 0 end + length('[Site ""]') + length(site) + 1
  + length('[Date ""]') + length(date) + 1 + length('[Round ""]') + length(round) + 1
  + length('[White "W"]') + length(cast(match as varchar)) + 1 + length('[Result ""]') + length(result) + 1
  + 1 + body - 1 + length(' *') + 2 as size from ({MATCHES_SQL})) group by place, name""", ("plies",))
def pgn_file_coverage(spark, folder):
    """Listed size of every game file, the bytes that a tolerant scan read of it, and its verdict."""
    root = game_files(spark, folder)
    listed = games.list_categories(spark, root)
    pieces = materialise(games.scan_category_pieces(spark, root).withColumn("__game", F.col("record").isNotNull()).drop("record"), "pieces")
    unread = games.unread_files(pieces, listed).select("source_file", F.lit(True).alias("unread"))
    read = pieces.groupBy("source_file").agg(
        (F.sum("__bytes") - len(games.SEPARATOR)).alias("bytes_read"), F.count_if("__game").alias("games"))
    return listed.join(read, "source_file", "left").join(unread, "source_file", "left").select(
        "source_file", "size", "bytes_read", "games", F.coalesce("unread", F.lit(False)).alias("unread"))


def parsed(spark, folder, *, faults: bool = False) -> DataFrame:
    return games.parse_records(records(spark, folder, faults=faults))


@query("pgn_roundtrip", f"""
select physical_game_id, block, ply, replace(san, '!', '') as san, case when cents % 4 = 0 then cents % 7200 + 0.5e0 end as clock_seconds
from {_BLOCKED}""", ("plies",))
def pgn_roundtrip(spark, folder):
    good = games.good_games(parsed(spark, folder))
    out = games.explode_plies(good, ["physical_game_id", "block"])
    return out.select("physical_game_id", "block", F.col("ply_number").alias("ply"), "san", "clock_seconds")


@query("reject_split", f"""
select physical_game_id, block, 'The "' || physical_game_id || '" one' as white, case {_FAULT} when 0 then 'no mainline moves'
  when 1 then 'unreadable move token' when 2 then 'unbalanced variation' end as error,
  cast(case when {_FAULT} > 2 then count(*) else 0 end as bigint) as plies
from {_BLOCKED} group by 1, 2""", ("plies",))
def reject_split(spark, folder):
    """Good games with their ply count, rejects with reason and player."""
    keys = ["physical_game_id", "block"]
    p = materialise(parsed(spark, folder, faults=True).select(*keys, "headers", "moves", "reject_reason"), "split")
    bad = games.rejects(p, keys).select(*keys, "white", "error", F.lit(0).cast("bigint").alias("plies"))
    good = games.good_games(p).select(
        *keys, G.header("headers", "White").alias("white"), F.lit(None).cast("string").alias("error"),
        F.size("moves").cast("bigint").alias("plies"),
    )
    return good.unionByName(bad)


@query("header_normalise", """
select physical_game_id, ply_number, case when site = '?' then null else site end as site,
  case when date = '????.??.??' then null else date end as date, case when round = '-' then null else round end as round,
  nullif(player_elo, '') as player_elo, cast(try_cast(player_elo as int) as int) as elo,
  case when date = '2024.01.15' then date '2024-01-15' end as day
from plies""", ("plies",))
def header_normalise(spark, folder):
    return plies(spark, folder).select(
        *KEYS, *[G.known_value(c).alias(c) for c in ("site", "date", "round", "player_elo")],
        F.col("player_elo").try_cast("int").alias("elo"),
        F.to_date(F.try_to_timestamp(G.known_value("date"), F.lit("yyyy.MM.dd"))).alias("day"),
    )


@query("clock_seconds", f"""
select physical_game_id, ply_number, case when cents % 5 <> 0 then {sql_r6("cents % 86400 + (cents % 10)/10.0e0")} end as clock
from plies""", ("plies",))
def clock_seconds(spark, folder):
    text = F.format_string("%d:%02d:%02d.%d", *[
        F.expr(e) for e in ("cents % 86400 div 3600", "cents % 3600 div 60", "cents % 60", "cents % 10")
    ])
    return plies(spark, folder).select(*KEYS, r6(G.clock_seconds(F.when(F.col("cents") % 5 != 0, text))).alias("clock"))


def _clean_sql(text: str) -> str:
    """The main-line clean-up in a dialect without look-around."""
    out = f"regexp_replace({text}, '(?m)^%.*$', ' ', 'g')"
    header = r'(?m)^[ \t]*\[[ \t]*[A-Za-z0-9_]+[ \t]+"(?:[^"\\]|\\.)*"[ \t]*\][ \t\r]*$'
    steps = [(header, " "), (r"\{[^}]*\}", " "), ("(?m);.*$", " ")]
    steps += [(r"\([^()]*\)", " ")] * _MESSAGE_NESTING
    steps += [(r"\$\d+", " "), (r"\s+", "  ")]
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"' ' || {out} || ' '"
    for pattern in (r" (1-0|0-1|1/2-1/2|\*) ", r" \d+\s*\.+"):
        out = f"regexp_replace({out}, '{pattern}', '  ', 'g')"
    return f"trim({out})"


_SQL_TEXT = """case doc_id % 4 when 1 then '[Event "D"]' || chr(10) || chr(10) || '{' || replace(text, '}', '') || '} *'
  when 2 then '[Event "D"]' || chr(10) || chr(10) || '{' || replace(text, '}', '') || '} 1. e4 {x} e5 ' || text
  when 3 then '%' || replace(text, chr(10), chr(10) || '%') else text end"""


@query("pgn_validate", f"""
select doc_id, message = '{G.MSG_VALID}' as is_valid, message from (
  select doc_id, case when not regexp_matches(t, '\\S') then '{G.MSG_EMPTY}'
    when not regexp_matches(regexp_replace(t, '(?m)^[%;].*$', '', 'g'), '\\S') then '{G.MSG_NO_GAME}'
    when regexp_matches({_clean_sql("t")}, '^{G.SAN}(?:\\s|$)') then '{G.MSG_VALID}'
    else '{G.MSG_NO_MOVES}' end as message
  from (select doc_id, {_SQL_TEXT} as t from documents))""")
def pgn_validate(spark, folder):
    """Whole documents as they are, and wrapped as header-only, valid and comment-only records."""
    text = F.expr(_SQL_TEXT)
    return table(spark, folder, "documents").select("doc_id", G.check_text(text).alias("c")).select(
        "doc_id", "c.is_valid", "c.message"
    )
