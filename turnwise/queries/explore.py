"""Data quality, distributions and cohorts."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import audit, cohort, explore
from turnwise.operators.features import benchmark_features
from turnwise.operators.profile import profile
from turnwise.plans.eda import CORRELATED
from turnwise.queries.registry import PLAYER, enriched, plies, query, rounded, scored, sql_r6
from turnwise.schemas import BASE_FEATURES, MOVE_COLUMNS, MOVE_TABLE
from turnwise.session import materialise, scratch_folder
from turnwise.sources import sinks, tables
from turnwise.sources.adapters import table


@query("dataset_audit", f"""
with games as (select game_id, arg_min(is_cheating_player_game, ply_number) as y from plies group by 1)
select count(*) as total_move_rows, (select count(*) from games) as total_player_games,
  count(distinct physical_game_id) as unique_physical_matches, count(distinct player_id) as unique_players,
  count(*) filter (is_used) as used_decision_points, count(*) filter (not is_cheating_move) as fair_moves,
  count(*) filter (is_cheating_move) as cheating_moves,
  {sql_r6('count(*) filter (is_cheating_move) / count(*)')} as cheating_move_rate,
  (select count(*) filter (not y) from games) as fair_games, (select count(*) filter (y) from games) as cheating_games,
  (select {sql_r6('count(*) filter (y) / count(*)')} from games) as cheating_game_rate,
  (select {sql_r6('count(*) filter (not y) / count(*)')} from games) as majority_class_baseline_accuracy
from plies""".replace("with games as", "select * from (with games as") + ")", ("plies",))
def dataset_audit(spark, folder):
    out = audit.dataset_audit(plies(spark, folder), order="ply_number")
    return rounded(out, "cheating_move_rate", "cheating_game_rate", "majority_class_baseline_accuracy")


_NULLABLE = (
    "physical_game_id game_id player_id opponent_id player_color ply_number cents is_used game_phase centipawn_loss"
    " eval_before eval_after move_stockfish_1 move_stockfish_15 move_player is_capture is_check is_promotion"
    " legal_moves_count source_category is_cheating_player_game is_cheating_move source_file event site date round"
    " result player_elo opponent_elo"
).split()


@query("missing_report", f"""
select * from ({' union all '.join(
    f"select '{c}' as column, count(*) - count({c}) as missing_count, "
    f"{sql_r6(f'(count(*) - count({c})) * 100.0 / count(*)')} as missing_pct from plies" for c in _NULLABLE)})
where missing_count > 0""", ("plies",))
def missing_report(spark, folder):
    return rounded(audit.missing_report(plies(spark, folder), _NULLABLE), "missing_pct")


@query("dataset_columns", f"""
select {len(_NULLABLE)} as columns_count, '{",".join(_NULLABLE)}' as columns, string_agg(c || '=' || n, ',' order by c) as missing from (
  {' union all '.join(f"select '{c}' as c, count(*) - count({c}) as n from plies" for c in _NULLABLE)}) where n > 0""", ("plies",))
def dataset_columns(spark, folder):
    """The column part of the audit document of a labelled table."""
    found = audit.dataset_document(plies(spark, folder).select(*_NULLABLE), order="ply_number")
    shown = F.transform(F.array_sort(F.map_keys("missing_values_per_column")),
                        lambda k: F.concat(k, F.lit("="), F.element_at("missing_values_per_column", k).cast("string")))
    return found.select("columns_count", F.array_join("columns", ",").alias("columns"), F.array_join(shown, ",").alias("missing"))


@query("csv_roundtrip", """
select cast(physical_game_id as int) as game_id, ply_number, nullif(player_elo, '') as player_elo, centipawn_loss,
  played_move_rank_top5, is_engine_eval_missing, 'a "b", c' as event from enriched""", ("enriched",))
def csv_roundtrip(spark, folder):
    """The move table written as fixed-column CSV and read back with its types; empty text is missing."""
    own = enriched(spark, folder).withColumns({"game_id": F.col("physical_game_id").cast("int"), "event": F.lit('a "b", c')})
    moves = own.select(*[
        (F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MOVE_TABLE.fields
    ])
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(moves, path, MOVE_COLUMNS)
    return tables.move_table(spark, path).select(
        "game_id", F.col("ply_number").cast("bigint").alias("ply_number"), "player_elo", F.col("centipawn_loss").cast("bigint").alias("centipawn_loss"),
        "played_move_rank_top5", "is_engine_eval_missing", "event",
    )


@query("document_roundtrip", """
select n_nationkey as category, 'f' || cast(s_suppkey as varchar) as file, cast(s_suppkey * 3 as bigint) as moves, s_name as status, 'n' || cast(s_nationkey as varchar) as authenticity
from supplier join nation on s_nationkey = n_nationkey""")
def document_roundtrip(spark, folder):
    """Documents of nested arrays, one per nation, written as JSON and flattened again."""
    one = table(spark, folder, "supplier").select("s_nationkey", F.struct(
        F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), F.col("s_nationkey").cast("string").alias("category"),
        (F.col("s_suppkey") * 3).cast("bigint").alias("moves_extracted"),
        F.struct(F.col("s_name").alias("provenance_status"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("authenticity")).alias("provenance_audit"),
    ).alias("f"))
    path = f"{scratch_folder(spark)}/documents-{uuid.uuid4().hex}"
    sinks.write_document(one.groupBy("s_nationkey").agg(F.collect_list("f").alias("files_processed")).drop("s_nationkey"), path)
    return tables.document(spark, path, tables.MANIFEST_FILES).select(F.explode("files_processed").alias("f")).select(
        F.col("f.category").cast("int").alias("category"), "f.file", F.col("f.moves_extracted").alias("moves"),
        F.col("f.provenance_audit.provenance_status").alias("status"), F.col("f.provenance_audit.authenticity").alias("authenticity"),
    )


@query("duplicate_keys", """
select 'doc text' as what, cast(sum(n - 1) as bigint) as duplicates from (select count(*) as n from documents group by text)
union all select 'order line', cast(sum(n - 1) as bigint) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""")
def duplicate_keys(spark, folder):
    """Long texts are compared by digest, so that the texts themselves do not shuffle."""
    digests = table(spark, folder, "documents").select(F.sha2("text", 256).alias("digest"))
    found = {
        "doc text": audit.duplicate_rows(digests, ["digest"]),
        "order line": audit.duplicate_rows(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]),
    }
    parts = [df.select(F.lit(name).alias("what"), "duplicates") for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query("class_balance", f"""
select count(*) filter (y = 0) as negatives, count(*) filter (y = 1) as positives, {sql_r6('avg(y)')} as positive_rate,
  {sql_r6('1 - avg(y)')} as majority_share from scored""", ("scored",))
def class_balance(spark, folder):
    return rounded(audit.class_balance(scored(spark, folder), "y"), "positive_rate", "majority_share")


@query("label_balance", f"""
select count(*) as documents, count(quality) as labelled, {sql_r6('avg(quality)')} as quality_rate, {sql_r6('avg(toxic)')} as toxic_rate,
  lang from documents left join labels using (doc_id) group by lang""")
def label_balance(spark, folder):
    """Left join with misses: labels cover some documents."""
    joined = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    out = joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.avg("quality").alias("quality_rate"),
        F.avg("toxic").alias("toxic_rate"),
    )
    return rounded(out, "quality_rate", "toxic_rate")


@query("group_compare", " union all ".join(
    f"""select '{g}' as grouping, {g} as value, count(ply_number) as total_moves, {sql_r6('avg(centipawn_loss)')} as mean_cp_loss,
    {sql_r6('median(centipawn_loss)')} as median_cp_loss, {sql_r6('avg(is_engine_top1)')} as top1_match_rate
    from enriched group by {g}""" for g in ("game_phase", "source_category")
), ("enriched",))
def group_compare(spark, folder):
    """Both groupings off one pass over the moves."""
    moves = enriched(spark, folder).select("game_phase", "source_category", "ply_number", "centipawn_loss", "is_engine_top1")
    both = moves.select(
        "*", F.inline(F.array(*[
            F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in ("game_phase", "source_category")
        ]))
    ).withColumn("key", F.struct("grouping", "value"))
    out = explore.compare_groups(both, "key").select("key.*", "total_moves", "mean_cp_loss", "median_cp_loss", "top1_match_rate")
    return rounded(out, "mean_cp_loss", "median_cp_loss", "top1_match_rate")


def _describe_sql(column: str, source: str) -> str:
    return (
        f"select '{column}' as feature, count({column}) as count, {sql_r6(f'avg({column})')} as mean,"
        f" {sql_r6(f'stddev_samp({column})')} as std, {sql_r6(f'min({column})')} as min,"
        f" {sql_r6(f'quantile_cont({column}, 0.25)')} as p25, {sql_r6(f'quantile_cont({column}, 0.5)')} as p50,"
        f" {sql_r6(f'quantile_cont({column}, 0.75)')} as p75, {sql_r6(f'max({column})')} as max from {source}"
    )


_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]
_DESCRIBED = ["centipawn_loss", "best_vs_second_cp_gap", "eval_before", "legal_moves_count"]
_PROFILED = ["mean_centipawn_loss", "std_centipawn_loss", "top1_match_rate", "blunder_rate"]


@query("describe_exact", " union all ".join(
    [_describe_sql(c, "enriched") for c in _DESCRIBED]
), ("enriched",))
def describe_exact(spark, folder):
    moves = materialise(enriched(spark, folder).select(*_DESCRIBED), "describe")
    return rounded(explore.describe(moves, _DESCRIBED), *_STATS)


@query("describe_events", _describe_sql("value", "events"))
def describe_events(spark, folder):
    """Exact quartiles of a float column by sketch brackets, without the small-table shortcut."""
    return rounded(explore.describe(table(spark, folder, "events"), ["value"]), *_STATS)


@query("describe_profiles", " union all ".join(
    _describe_sql(c, "features") for c in _PROFILED
), ("features",))
def describe_profiles(spark, folder):
    features = materialise(benchmark_features(plies(spark, folder), order="ply_number"), "features")
    return rounded(explore.describe(features, _PROFILED), *_STATS)


@query("corr_matrix", " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, {sql_r6(f'corr({a}, {b})')} as corr from enriched"
    for a in CORRELATED for b in CORRELATED
), ("enriched",))
def corr_matrix(spark, folder):
    return rounded(explore.correlations(enriched(spark, folder), CORRELATED), "corr")


@query("rank_distribution", """
select coalesce(cast(played_move_rank_top5 as varchar), 'Unranked (>5)') as rank, count(*) as moves from enriched group by 1""", ("enriched",))
def rank_distribution(spark, folder):
    return explore.rank_distribution(enriched(spark, folder))


# losses squared: the plain ones have no value above the fence
_WIDE = "(select *, centipawn_loss * centipawn_loss // 100 as wide_loss from plies)"
_FENCE_SQL = f"(select quantile_cont(wide_loss, 0.25) as q25, quantile_cont(wide_loss, 0.75) as q75 from {_WIDE})"


def _wide(spark, folder):
    return plies(spark, folder).withColumn("wide_loss", F.expr("centipawn_loss * centipawn_loss div 100"))


@query("iqr_fence", f"""
select {sql_r6('q25')} as q25, {sql_r6('q75')} as q75, {sql_r6('q75 - q25')} as iqr, {sql_r6('q75 + 1.5 * (q75 - q25)')} as upper_bound
from {_FENCE_SQL}""", ("plies",))
def iqr_fence(spark, folder):
    return rounded(explore.iqr_fence(_wide(spark, folder), "wide_loss"), "q25", "q75", "iqr", "upper_bound")


@query("iqr_outliers", f"""
select physical_game_id, ply_number, wide_loss from {_WIDE}, {_FENCE_SQL} where wide_loss > q75 + 1.5 * (q75 - q25)""", ("plies",))
def iqr_outliers(spark, folder):
    return explore.outliers(_wide(spark, folder), "wide_loss").select("physical_game_id", "ply_number", "wide_loss")


@query("top_outliers", f"""
select physical_game_id, ply_number, player_color, wide_loss from {_WIDE}, {_FENCE_SQL}
where wide_loss > q75 + 1.5 * (q75 - q25) order by physical_game_id, ply_number limit 5""", ("plies",))
def top_outliers(spark, folder):
    first = explore.first_outliers(
        _wide(spark, folder), 5, value="wide_loss", order=("physical_game_id", "ply_number")
    )
    return first.select("physical_game_id", "ply_number", "player_color", "wide_loss")


def _hist_sql(value: str, source: str, bins: int) -> str:
    return f"""
select '{value}' as feature, bin, {sql_r6('lo + bin * (hi - lo) / ' + str(bins))} as left_edge, count(*) as rows from (
  select lo, hi, cast(least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1}) as int) as bin
  from {source}, (select cast(min({value}) as double) as lo, cast(max({value}) as double) as hi from {source})
  where {value} is not null) group by bin, lo, hi"""


_BINS = (("centipawn_loss", 25), ("legal_moves_count", 20), ("best_vs_second_cp_gap", 20))


@query("histogram", " union all ".join(_hist_sql(c, "enriched", n) for c, n in _BINS), ("enriched",))
def histogram(spark, folder):
    p = materialise(enriched(spark, folder).select(*[c for c, _ in _BINS]), "histogram")
    parts = [
        explore.histogram(p, c, n).select(F.lit(c).alias("feature"), "bin", "left_edge", "rows")
        for c, n in _BINS
    ]
    return rounded(functools.reduce(DataFrame.unionByName, parts), "left_edge")


@query("loss_histogram", f"""
select player_color, bin, {sql_r6('bin * top / 14')} as left_edge, count(*) as rows from (
  select player_color, top, cast(least(floor(centipawn_loss / (top / 14)), 13) as int) as bin
  from plies, (select least(300.0e0, greatest(max(centipawn_loss), 50.0e0)) as top from plies)
  where centipawn_loss is not null and centipawn_loss <= top) group by player_color, bin, top""", ("plies",))
def loss_histogram(spark, folder):
    return rounded(explore.loss_histogram(plies(spark, folder)), "left_edge").drop("right_edge")


@query("boxplot_stats", " union all ".join(f"""
select '{g}' as grouping, b.{g} as value, {sql_r6('q1')} as q1, {sql_r6('med')} as med, {sql_r6('q3')} as q3,
  min(centipawn_loss) filter (centipawn_loss between q1 - 1.5*(q3-q1) and q3 + 1.5*(q3-q1)) as whisker_low,
  max(centipawn_loss) filter (centipawn_loss between q1 - 1.5*(q3-q1) and q3 + 1.5*(q3-q1)) as whisker_high,
  count(*) filter (centipawn_loss < q1 - 1.5*(q3-q1) or centipawn_loss > q3 + 1.5*(q3-q1)) as outliers
from plies p join (select {g}, quantile_cont(centipawn_loss, 0.25) as q1, median(centipawn_loss) as med,
  quantile_cont(centipawn_loss, 0.75) as q3 from plies group by {g}) b on p.{g} = b.{g} where centipawn_loss is not null
group by b.{g}, q1, med, q3""" for g in ("source_category", "game_phase", "player_color")), ("plies",))
def boxplot_stats(spark, folder):
    """All three groupings as one grouping column, so the moves are read once per use."""
    groups = ("source_category", "game_phase", "player_color")
    long = plies(spark, folder).select(
        "centipawn_loss",
        F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in groups])).alias("key"),
    )
    return rounded(explore.boxplot(long, "key").select("key.*", "*").drop("key"), "q1", "med", "q3")


@query("cohort_stats", " union all ".join(
    f"select is_cheating, '{f}' as feature, {sql_r6(f'avg({f})')} as mean, {sql_r6(f'stddev_samp({f})')} as std from features group by 1"
    for f in BASE_FEATURES
), ("features",))
def cohort_stats(spark, folder):
    features = benchmark_features(plies(spark, folder), order="ply_number")
    return rounded(cohort.cohort_stats(features, "is_cheating", BASE_FEATURES), "mean", "std")


_Z = BASE_FEATURES


@query("cohort_zscore", " union all ".join(
    f"""select game_id, '{f}' as feature, {sql_r6(f)} as value, {sql_r6(f'({f} - m0) / nullif(s0, 0)')} as z0, {sql_r6(f'({f} - m1) / nullif(s1, 0)')} as z1
    from features, (select avg({f}) filter (is_cheating = 0) as m0, stddev_samp({f}) filter (is_cheating = 0) as s0,
    avg({f}) filter (is_cheating = 1) as m1, stddev_samp({f}) filter (is_cheating = 1) as s1 from features)""" for f in _Z
), ("features",))
def cohort_zscore(spark, folder):
    features = benchmark_features(plies(spark, folder), order="ply_number")
    return rounded(cohort.cohort_distance(features, ["game_id"], "is_cheating", _Z), "value", "z0", "z1")


_H = "case when move_player = move_stockfish_15 then 1.0 else 0.0 end"
_SAME = "coalesce(move_stockfish_1 = move_stockfish_15, false)"


@query("stability_by_cohort", f"""
select is_cheating_player_game as assisted, count(*) as plies, {sql_r6(f'avg(case when {_SAME} then 1.0 else 0.0 end)')} as stable_share,
  {sql_r6(f'avg({_H}) filter ({_SAME})')} as stable_match, {sql_r6(f'avg({_H}) filter (not {_SAME})')} as unstable_match
from plies where is_used group by 1""", ("plies",))
def stability_by_cohort(spark, folder):
    out = cohort.stability(
        plies(spark, folder).withColumn("assisted", F.col("is_cheating_player_game")), "assisted",
        shallow="move_stockfish_1", deep="move_stockfish_15", played="move_player",
    )
    return rounded(out, "stable_share", "stable_match", "unstable_match")


#: Weights of all 13 features by their place, made up for the check.
_COEF = {f: round((-1) ** k * (k + 1) / 20, 4) for k, f in enumerate(BASE_FEATURES)}
_CENTER = {f: 0.25 * (k + 1) for k, f in enumerate(BASE_FEATURES)}
_SCALE = {f: 1.5 + k for k, f in enumerate(BASE_FEATURES)}
_BIAS = -0.465
_PARTS = {f: f"(coalesce({f}, {_CENTER[f]}e0) - {_CENTER[f]}e0) / {_SCALE[f]}e0 * {_COEF[f]}e0" for f in _COEF}
_ODDS = f"({_BIAS}e0 + {' + '.join(f'({p})' for p in _PARTS.values())})"


@query("score_contributions", " union all ".join(
    f"""select game_id, {sql_r6(_ODDS)} as log_odds, {sql_r6(f'1.0/(1.0+exp(-{_ODDS}))')} as probability, '{f}' as feature,
    {sql_r6(p)} as contribution from features""" for f, p in _PARTS.items()
), ("features",))
def score_contributions(spark, folder):
    features = benchmark_features(plies(spark, folder), order="ply_number")
    out = cohort.score_contributions(features, ["game_id"], _COEF, _CENTER, _SCALE, _BIAS)
    return rounded(out, "log_odds", "probability", "contribution")


@query("strict_profile", f"""
select physical_game_id, player_color, count(*) filter (is_engine_top1 = 1 and centipawn_loss is not null) as top1_match_count,
  {sql_r6('count(*) filter (is_engine_top1 = 1 and centipawn_loss is not null) / nullif(count(centipawn_loss), 0)')} as top1_match_rate
from enriched group by 1, 2""", ("enriched",))
def strict_profile(spark, folder):
    """Match rates over scored plies only."""
    out = profile(enriched(spark, folder), keys=PLAYER, context=["event"], strict_rates=True)
    return rounded(out.select(*PLAYER, "top1_match_count", "top1_match_rate"), "top1_match_rate")
