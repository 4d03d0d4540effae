"""Ply projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import moves as M
from turnwise.functions.numeric import coerce
from turnwise.operators import audit, explore, report
from turnwise.queries.registry import (
    KEYS, NORM_SQL, array_sql, enriched, plies, query, r6, scored, sql_r6,
)
from turnwise.sources import games as G
from turnwise.sources.adapters import FEN_SAMPLES, SAN_SAMPLES, table

V = ("plies",)


@query("scan_filter_project", """
select l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice from lineitem
where l_shipdate < timestamp '1998-01-01' and l_quantity > 40""")
def scan_filter_project(spark, folder):
    """Filter and columns reach the scan."""
    early = (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 40)
    return table(spark, folder, "lineitem").filter(early).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
    )


@query("ply_numbering", """
select physical_game_id, ply_number, player_color, cast((ply_number + 1)//2 as int) as fullmove_number from plies""", V)
def ply_numbering(spark, folder):
    return plies(spark, folder).select(
        *KEYS, M.color_of_ply("ply_number").alias("player_color"), M.fullmove_of_ply("ply_number").alias("fullmove_number")
    )


@query("perspective_columns", """
select physical_game_id, ply_number, player_id as player_name, opponent_id as opponent_name, player_elo, opponent_elo
from plies""", V)
def perspective_columns(spark, folder):
    """From white/black columns back to mover and opponent."""
    p = plies(spark, folder)
    white = F.col("player_color") == "White"
    sides = p.select(
        *KEYS, "player_color",
        F.when(white, F.col("player_id")).otherwise(F.col("opponent_id")).alias("white_player"),
        F.when(white, F.col("opponent_id")).otherwise(F.col("player_id")).alias("black_player"),
        F.when(white, F.col("player_elo")).otherwise(F.col("opponent_elo")).alias("white_elo"),
        F.when(white, F.col("opponent_elo")).otherwise(F.col("player_elo")).alias("black_elo"),
    )
    return G.with_perspective(sides).select(*KEYS, "player_name", "opponent_name", "player_elo", "opponent_elo")


_FEN = f"{array_sql(FEN_SAMPLES)}[1 + cents % 4]"
_PIECES = f"length(regexp_replace(split_part({_FEN}, ' ', 1), '[^nbrqNBRQ]', '', 'g'))"


@query("phase_bucket", f"""
select physical_game_id, ply_number,
  case when {_PIECES} > 12 then 'Opening' when {_PIECES} < 6 then 'Endgame' else 'Middlegame' end as game_phase,
  cast({_PIECES} as int) as pieces
from plies""", V)
def phase_bucket(spark, folder):
    fen = F.element_at(F.array(*[F.lit(f) for f in FEN_SAMPLES]), (1 + F.col("cents") % 4).cast("int"))
    return plies(spark, folder).withColumn("fen", fen).select(
        *KEYS, M.game_phase("fen").alias("game_phase"), M.piece_count("fen").alias("pieces")
    )


@query("san_flags", f"""
select physical_game_id, ply_number, san, cast(contains(san, 'x') as int) as is_capture,
  cast(san like '%+' or san like '%#' as int) as is_check, cast(contains(san, '=') as int) as is_promotion
from (select *, {array_sql(SAN_SAMPLES)}[1 + cents % 10] as san from plies)""", V)
def san_flags(spark, folder):
    san = F.element_at(F.array(*[F.lit(s) for s in SAN_SAMPLES]), (1 + F.col("cents") % 10).cast("int"))
    p = plies(spark, folder).withColumn("san", san)
    return p.select(*KEYS, "san", *[c.alias(n) for n, c in M.san_flags("san").items()])


@query("score_split", """
select physical_game_id, ply_number, case when k in (0, 1) then null when k = 2 then null else cast(eval_before as int) end as cp,
  case when k in (0, 1) then cast(cents % 9 as int) end as mate,
  case when k = 0 then 1 when k = 1 then -1 end as mate_sign,
  case when k = 0 then '#+' || (cents % 9) when k = 1 then '#-' || (cents % 9) when k = 2 then null
       else cast(eval_before as varchar) end as score_text
from (select *, (cents//3) % 6 as k from plies)""", V)
def score_split(spark, folder):
    text = F.expr(
        "case (cents div 3) % 6 when 0 then concat('#+', cents % 9) when 1 then concat('#-', cents % 9)"
        " when 2 then '' else cast(eval_before as string) end"
    )
    return plies(spark, folder).select(*KEYS, M.parse_score(text).alias("s")).select(
        *KEYS, "s.cp", "s.mate", "s.mate_sign", M.score_text(F.col("s")).alias("score_text")
    )


@query("terminal_score", f"""
select physical_game_id, ply_number, case when san = 'Qh5#' and player_color = 'White' then '#+0'
  when san = 'Qh5#' then '#-0' when cents % 17 = 0 then '0' end as score_after
from (select *, {array_sql(SAN_SAMPLES)}[1 + cents % 10] as san from plies)""", V)
def terminal_score(spark, folder):
    san = F.element_at(F.array(*[F.lit(s) for s in SAN_SAMPLES]), (1 + F.col("cents") % 10).cast("int"))
    return plies(spark, folder).select(
        *KEYS, M.terminal_score(san, "player_color", F.col("cents") % 17 == 0).alias("score_after")
    )


@query("centipawn_loss", """
select physical_game_id, ply_number, case when player_color = 'White' and eval_after is not null
    then least(greatest(eval_before*9 - eval_after*9, 0), 2000)
  when eval_after is not null then least(greatest(eval_after*9 - eval_before*9, 0), 2000) end as loss
from plies""", V)
def centipawn_loss(spark, folder):
    """Evaluations nine-fold, so that the cap is reached."""
    before, after = F.col("eval_before") * 9, F.col("eval_after") * 9
    return plies(spark, folder).select(*KEYS, M.centipawn_loss(before, after, "player_color").alias("loss"))


@query("win_prob_loss", f"""
select physical_game_id, ply_number, {sql_r6(NORM_SQL)} as norm_loss from plies""", V)
def win_prob_loss(spark, folder):
    before, after = M.mover_view("eval_before", "player_color"), M.mover_view("eval_after", "player_color")
    return plies(spark, folder).select(*KEYS, r6(M.win_prob_loss(before, after)).alias("norm_loss"))


@query("eval_flags", """
select physical_game_id, ply_number, is_forced_mate, is_engine_eval_missing from enriched""", ("enriched",))
def eval_flags(spark, folder):
    return enriched(spark, folder).select(*KEYS, "is_forced_mate", "is_engine_eval_missing")


@query("move_quality", """
select physical_game_id, ply_number, case when centipawn_loss is null and is_forced_mate = 1 then 'Forced Mate'
  when centipawn_loss is null then null when centipawn_loss = 0 or is_engine_top1 = 1 then 'Best'
  when centipawn_loss <= 25 then 'Excellent' when centipawn_loss <= 50 then 'Good'
  when centipawn_loss <= 100 then 'Inaccuracy' when centipawn_loss <= 200 then 'Mistake' else 'Blunder' end as move_quality
from enriched""", ("enriched",))
def move_quality(spark, folder):
    return enriched(spark, folder).select(*KEYS, "move_quality")


@query("physical_match", """
select physical_game_id as match_id, count(distinct game_id) as player_games, count(*) as plies from plies group by 1""", V)
def physical_match(spark, folder):
    per_game = plies(spark, folder).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return per_game.groupBy(M.match_id("game_id").alias("match_id")).agg(
        F.count(F.lit(1)).alias("player_games"), F.sum("n").alias("plies")
    )


@query("decision_points", """
select physical_game_id, ply_number, game_id, centipawn_loss from plies where ply_number >= 21""", V)
def decision_points(spark, folder):
    used = plies(spark, folder).filter(F.col("ply_number") >= M.DECISION_PLY)
    return used.select(*KEYS, "game_id", "centipawn_loss")


@query("plies_by_color", """
select physical_game_id, ply_number, player_color, centipawn_loss from plies where lower(player_color) = 'black'""", V)
def plies_by_color(spark, folder):
    return explore.color_plies(plies(spark, folder), "BLACK").select(*KEYS, "player_color", "centipawn_loss")


_TEXT = (
    "case cents % 5 when 0 then cast(cents as {s}) when 1 then 'n/a' when 2 then '' when 3 then '12.5'"
    " else cast(eval_before as {s}) end"
)


@query("safe_cast", f"""
select physical_game_id, ply_number, try_cast({_TEXT.format(s='varchar')} as double) as number from plies""", V)
def safe_cast(spark, folder):
    return plies(spark, folder).select(*KEYS, coerce(F.expr(_TEXT.format(s="string"))).alias("number"))


@query("player_result", """
select physical_game_id, player_color, case when result = '1/2-1/2' then 'draw' when result = '*' then 'unknown'
  when (result = '1-0') = (player_color = 'White') then 'win' else 'loss' end as player_result, count(*) as plies
from plies group by 1, 2, 3""", V)
def player_result(spark, folder):
    outcome = M.player_result("result", "player_color").alias("player_result")
    return plies(spark, folder).groupBy("physical_game_id", "player_color", outcome).agg(F.count(F.lit(1)).alias("plies"))


_PATH = (
    "concat(o_orderpriority, '{slash}', case o_custkey % 6 when 0 then 'Immortal_Game.pgn' when 1 then"
    " 'opera_game_1858.PGN' when 2 then 'my_tcec_engine_game.pgn' when 3 then 'casual_game.pgn.pgn'"
    " when 4 then 'casual_game.txt' else concat(cast(o_custkey as {s}), '.pgn') end)"
)


@query("provenance_rules", f"""
select provenance_status, authenticity, count(*) as files from (
  select case when f like '%immortal_game.pgn%' or f like '%opera_game_1858.pgn%' then 'verified_historical_human'
    when f like '%tcec_engine_game.pgn%' then 'illustrative_engine_demonstration_unverified'
    when f like '%casual_game.pgn%' then 'synthetic_programmatic_demonstration' else 'unverified_user_input'
    end as provenance_status,
  case when f like '%immortal_game.pgn%' or f like '%opera_game_1858.pgn%' then 'Independently verified'
    when f like '%tcec_engine_game.pgn%' then 'Unverified demonstration data'
    when f like '%casual_game.pgn%' then 'Programmatically constructed test game' else 'Unverified'
    end as authenticity
  from (select lower({_PATH.format(slash='/', s='varchar')}) as f from orders)) group by 1, 2""")
def provenance_rules(spark, folder):
    path = F.expr(_PATH.format(slash="/", s="string"))
    labelled = table(spark, folder, "orders").select(audit.provenance(path).alias("p"))
    return labelled.groupBy("p.provenance_status", "p.authenticity").agg(F.count(F.lit(1)).alias("files"))


_CLASS_SQL = "case when p >= 0.5 then 'engine-assisted' else 'human-like' end"


@query("score_class", f"""
select game_id, {_CLASS_SQL} as classification, round(p, 4) as engine_assisted_likelihood,
  round(1 - p, 4) as human_like_likelihood from scored""", ("scored",))
def score_class(spark, folder):
    return report.classify(scored(spark, folder)).select(
        "game_id", "classification", "engine_assisted_likelihood", "human_like_likelihood"
    )


@query("score_card", f"""
select game_id, p >= 0.5 as is_assisted, case when p >= 0.5 then 'ENGINE-ASSISTED' else 'HUMAN-LIKE' end as badge_text,
  case when p >= 0.5 then 'Engine-assistance score' else 'Human-like score' end as primary_label,
  {sql_r6("case when p >= 0.5 then round(p, 4) else round(1 - p, 4) end * 100")} as primary_pct,
  {sql_r6("case when p >= 0.5 then round(1 - p, 4) else round(p, 4) end * 100")} as secondary_pct
from scored""", ("scored",))
def score_card(spark, folder):
    shown = report.classify(scored(spark, folder)).select(
        "game_id",
        report.player_card("classification", "engine_assisted_likelihood", "human_like_likelihood").alias("card"),
    )
    return shown.select(
        "game_id", "card.is_assisted", "card.badge_text", "card.primary_label",
        r6("card.primary_pct").alias("primary_pct"), r6("card.secondary_pct").alias("secondary_pct"),
    )


@query("depth_gate", f"""
select game_id, depth, depth = 15 as is_depth_compatible,
  case when depth = 15 then 'compatible' else 'incompatible_depth' end as status,
  case when depth = 15 then round(p, 4) end as score, case when depth = 15 then {_CLASS_SQL} end as classification
from (select *, case when cast(physical_game_id as bigint) % 3 = 0 then 10 else 15 end as depth from scored)""", ("scored",))
def depth_gate(spark, folder):
    return _gated(spark, folder, require=True)


@query("depth_gate_unverified", f"""
select game_id, depth, depth = 15 as is_depth_compatible,
  case when depth = 15 then 'compatible' else 'unverified_depth' end as status, round(p, 4) as score, {_CLASS_SQL} as classification
from (select *, case when cast(physical_game_id as bigint) % 3 = 0 then 10 else 15 end as depth from scored)""", ("scored",))
def depth_gate_unverified(spark, folder):
    """Scores at another depth kept and marked."""
    return _gated(spark, folder, require=False)


def _gated(spark, folder, *, require):
    depth = F.when(F.col("physical_game_id").cast("bigint") % 3 == 0, 10).otherwise(15)
    gated = report.depth_gate(scored(spark, folder).withColumn("depth", depth), "p", "depth", require=require)
    return gated.select("game_id", "depth", "is_depth_compatible", "status", "score", "classification")


@query("string_fns", """
select doc_id, lower(trim(lang)) as lang, upper(source) as source, contains(text, 'the') as has_the,
  starts_with(source, 's') as starts_s, length(replace(text, ' ', '')) as dense_chars,
  substr(text, 1, 5) as head, length(regexp_replace(text, '[0-9]', '', 'g')) as no_digits
from documents""")
def string_fns(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.lower(F.trim("lang")).alias("lang"), F.upper("source").alias("source"),
        F.col("text").contains("the").alias("has_the"), F.col("source").startswith("s").alias("starts_s"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("bigint").alias("dense_chars"),
        F.substring("text", 1, 5).alias("head"),
        F.length(F.regexp_replace("text", "[0-9]", "")).cast("bigint").alias("no_digits"),
    )


@query("math_fns", f"""
select event_id, {sql_r6("exp(-value/100)")} as decay, {sql_r6("least(greatest(value, 10.0), 50.0)")} as clamped,
  abs(cast(floor(value) as bigint) - 50) as off_centre, {sql_r6("value / nullif(user_id % 3, 0)")} as per_user,
  coalesce(nullif(event_type, 'error'), 'none') as kind
from events""")
def math_fns(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", r6(F.exp(-v / 100)).alias("decay"),
        r6(F.least(F.greatest(v, F.lit(10.0)), F.lit(50.0))).alias("clamped"),
        F.abs(F.floor(v) - 50).alias("off_centre"), r6(F.try_divide(v, F.col("user_id") % 3)).alias("per_user"),
        F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"),
    )


@query("array_map_fns", """
select conv_id, turn, cast(len(words) as int) as words, words[1] as first_word,
  cast(list_position(words, 'the') as bigint) as the_at, list_contains(words, 'and') as has_and,
  cast(len(list_filter(words, lambda w: length(w) > 4)) as int) as long_words
from (select *, string_split(text, ' ') as words from conversations)""")
def array_map_fns(spark, folder):
    words = F.split("text", " ")
    return table(spark, folder, "conversations").withColumn("words", words).select(
        "conv_id", "turn", F.size("words").alias("words"),
        F.element_at(F.map_from_arrays(F.array(F.lit("first")), F.array(F.element_at("words", 1))), F.lit("first")).alias("first_word"),
        F.nullif(F.array_position("words", F.lit("the")), F.lit(0)).alias("the_at"),
        F.array_contains("words", "and").alias("has_and"),
        F.size(F.filter("words", lambda w: F.length(w) > 4)).alias("long_words"),
    )


@query("json_props_extract", """
select event_id, event_type, cast(props->>'$.k' as int) as k, '{"type":"' || event_type || '"}' as doc from events""")
def json_props_extract(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.from_json("props", "k INT")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"))).alias("doc"),
    )
