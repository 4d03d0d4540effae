"""Folds, metrics, preprocessing and models."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.learn import certify, models, validate
from turnwise.learn.models import Spec
from turnwise.operators import folds, metrics, report
from turnwise.operators.features import benchmark_features
from turnwise.plans.prediction import predict
from turnwise.queries.registry import PLAYER, plies, positioned, query, rounded, scored, sql_r6
from turnwise.schemas import ALL_FEATURES, BASE_FEATURES
from turnwise.session import materialise, scratch_folder
from turnwise.sources.adapters import table

GROUP, LABEL = "physical_game_id", "is_cheating"
_METRICS = metrics.NAMES


def _fold_groups(spark, folder):
    return folds.assign_folds(scored(spark, folder), GROUP, "y")


def _with_folds(spark, folder):
    """Scores with their fold, from one table: the scores feed both sides of the join."""
    rows = materialise(scored(spark, folder), "scored")
    return rows.join(folds.assign_folds(rows, GROUP, "y").select(GROUP, "fold"), GROUP)


@query("group_kfold", """
select physical_game_id, n_rows as rows, cast(n_pos as bigint) as positives, fold from folded""", ("folded",))
def group_kfold(spark, folder):
    return _fold_groups(spark, folder)


_FOLDS = range(5)
_COSTS = ", ".join(
    f"{{'c': p{k} * n_pos * negatives * negatives + q{k} * (n_rows - n_pos) * positives * positives, 'r': p{k} + q{k}, 'k': {k}}}"
    for k in _FOLDS
)


@query("balanced_kfold", f"""
select * from (with recursive grouped as (
  select o_custkey as g, count(*) as n_rows, count(*) filter (o_orderpriority = '1-URGENT') as n_pos from orders group by 1),
ordered as (select g, n_rows, n_pos, positives, negatives,
  row_number() over (partition by n_rows, n_pos order by md5(cast(g as varchar) || ':42'), g) as place, row_number() over (
    order by (n_pos * negatives) * (n_pos * negatives) + ((n_rows - n_pos) * positives) * ((n_rows - n_pos) * positives) desc,
    n_rows desc, n_pos desc) as step
  from grouped, (select cast(sum(n_pos) as hugeint) as positives, cast(sum(n_rows - n_pos) as hugeint) as negatives from grouped)),
dealt as (
  select cast(0 as bigint) as step, -1 as fold, cast(0 as bigint) as n_rows, cast(0 as bigint) as n_pos,
    {', '.join(f'cast(0 as hugeint) as p{k}, cast(0 as hugeint) as q{k}' for k in _FOLDS)}
  union all
  select step, fold, n_rows, n_pos,
    {', '.join(f'p{k} + case when fold = {k} then n_pos else 0 end, q{k} + case when fold = {k} then n_rows - n_pos else 0 end' for k in _FOLDS)}
  from (select o.step, o.n_rows, o.n_pos, {', '.join(f'p{k}, q{k}' for k in _FOLDS)}, list_sort([{_COSTS.replace('n_rows', 'o.n_rows').replace('n_pos', 'o.n_pos')}])[1].k as fold
    from dealt d join ordered o on o.step = d.step + 1)),
shares as (select n_rows, n_pos, fold, count(*) as n, sum(count(*)) over (partition by n_rows, n_pos order by fold) as upto
  from dealt where step > 0 group by 1, 2, 3)
select g as o_custkey, n_rows as rows, cast(n_pos as bigint) as positives, cast(fold as int) as fold
from ordered o join shares s using (n_rows, n_pos) where place <= upto and place > upto - n)""")
def balanced_kfold(spark, folder):
    """Customers as groups of their orders; an urgent order is a positive."""
    orders = table(spark, folder, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return folds.balanced_folds(orders, "o_custkey", "urgent")


@query("fold_summary", f"""
select fold, cast((select sum(n_rows) from folded) - sum(n_rows) as bigint) as train_rows, cast(sum(n_rows) as bigint) as val_rows,
  (select count(*) from folded) - count(*) as train_groups, count(*) as val_groups,
  {sql_r6('((select sum(n_pos) from folded) - sum(n_pos)) / ((select sum(n_rows) from folded) - sum(n_rows))')} as train_positive_rate,
  {sql_r6('sum(n_pos) / sum(n_rows)')} as val_positive_rate, cast(0 as bigint) as overlap_groups
from folded group by fold""", ("folded",))
def fold_summary(spark, folder):
    return rounded(folds.fold_summary(_fold_groups(spark, folder), GROUP), "train_positive_rate", "val_positive_rate")


_ROW_FOLD = "cast(ascii(substr(md5(game_id), 1, 1)) % 5 as int)"


@query("leakage_check", f"""
select 'by group' as strategy, fold, count(distinct physical_game_id) as val_groups, cast(0 as bigint) as overlap_groups
from folded group by fold union all
select 'by row', fold, count(*), count(*) filter (n > 1) from (
  select physical_game_id, fold, count(*) over (partition by physical_game_id) as n from (
    select distinct physical_game_id, {_ROW_FOLD} as fold from scored)) group by fold""", ("folded",))
def leakage_check(spark, folder):
    """No overlap with grouped folds; row-wise folds show what a leak looks like."""
    by_group = folds.leakage(_fold_groups(spark, folder), GROUP)
    by_row = folds.leakage(scored(spark, folder).withColumn("fold", F.expr(_ROW_FOLD)), GROUP)
    return by_group.select(F.lit("by group").alias("strategy"), "*").unionByName(
        by_row.select(F.lit("by row").alias("strategy"), "*")
    )


def _cells_sql(score: str, source: str, by: str = "") -> str:
    """Threshold metrics of a score column."""
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    cell = "count(*) filter (y = {y} and " + score + " {op} 0.5)"
    tn, fp = cell.format(y=0, op="<"), cell.format(y=0, op=">=")
    fn, tp = cell.format(y=1, op="<"), cell.format(y=1, op=">=")
    return f"""select {keys}tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp) as accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f1_score
  from (select {keys}{tn} as tn, {fp} as fp, {fn} as fn, {tp} as tp from {source}{group})"""


def _ranking_sql(score: str, source: str, by: str = "") -> str:
    """Mann-Whitney form of the AUC from mid-ranks, and average precision from peer frames."""
    keys = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    group = f" group by {by}" if by else ""
    return f"""select {keys}(sum(y * midrank) - pos * (pos + 1) / 2.0) / (pos * (n - pos)) as roc_auc, sum(y * tp / above) / pos as pr_auc
  from (select {keys}y, rank() over ({part}order by {score}) + (count(*) over ({part.strip() + ',' if part else 'partition by '} {score}) - 1) / 2.0 as midrank,
    sum(y) over ({part}order by {score} desc) as tp, count(*) over ({part}order by {score} desc) as above,
    sum(y) over ({part}) as pos, count(*) over ({part}) as n from {source}) group by {keys}pos, n"""


def _shown(columns: list[str]) -> str:
    return ", ".join(f"{sql_r6(c)} as {c}" for c in columns)


_THRESHOLD = ["accuracy", "precision", "recall", "f1_score"]


@query("classification_metrics", f"select tn, fp, fn, tp, {_shown(_THRESHOLD)} from ({_cells_sql('p', 'scored')})", ("scored",))
def classification_metrics(spark, folder):
    return rounded(metrics.threshold_metrics(scored(spark, folder), "y", "p"), *_THRESHOLD)


@query("roc_auc", f"select {sql_r6('roc_auc')} as roc_auc from ({_ranking_sql('p', 'scored')})", ("scored",))
def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(scored(spark, folder), "y", "p").select("roc_auc"), "roc_auc")


@query("avg_precision", f"select {sql_r6('pr_auc')} as pr_auc from ({_ranking_sql('p', 'scored')})", ("scored",))
def avg_precision(spark, folder):
    return rounded(metrics.ranking_metrics(scored(spark, folder), "y", "p").select("pr_auc"), "pr_auc")


@query("brier", "select round(avg((p - y) * (p - y)), 10) as brier from scored", ("scored",))
def brier(spark, folder):
    """Ten decimals: the mean of four-decimal squares often ends on a tie at six."""
    return metrics.brier(scored(spark, folder), "y", "p").select(F.round("brier", 10).alias("brier"))


@query("fold_metrics", f"""
select fold, tn, fp, fn, tp, {_shown(_METRICS)} from ({_cells_sql('p', '(select * from scored join folded using (physical_game_id))', 'fold')})
join ({_ranking_sql('p', '(select * from scored join folded using (physical_game_id))', 'fold')}) using (fold)""", ("folded",))
def fold_metrics(spark, folder):
    return rounded(metrics.evaluate(_with_folds(spark, folder), "y", "p", by=["fold"]), *_METRICS)


@query("fold_spread", f"""
select count(*) as folds, {sql_r6('avg(accuracy)')} as mean_accuracy, {sql_r6('stddev_pop(accuracy)')} as std_accuracy
from ({_cells_sql('p', '(select * from scored join folded using (physical_game_id))', 'fold')})""", ("folded",))
def fold_spread(spark, folder):
    per_fold = metrics.threshold_metrics(_with_folds(spark, folder), "y", "p", by=["fold"])
    return rounded(metrics.fold_spread(per_fold), "mean_accuracy", "std_accuracy")


def _variant_sql(score: str) -> str:
    return f"select {', '.join(_METRICS)} from ({_cells_sql(score, 'scored')}), ({_ranking_sql(score, 'scored')})"


@query("metric_delta", f"""
select * from (with base as ({_variant_sql('p')}), other as ({_variant_sql('p_other')}) """ + " union all ".join(
    f"select '{m}' as metric, round(base.{m}, 4) as baseline, round(other.{m}, 4) as other,"
    f" {sql_r6(f'round(other.{m}, 4) - round(base.{m}, 4)')} as delta from base, other" for m in _METRICS
) + ")", ("scored",))
def metric_delta(spark, folder):
    """Metrics of two scores of the same rows, and their difference."""
    both = scored(spark, folder).select(
        "y", F.inline(F.array(*[
            F.struct(F.lit(c).alias("variant"), F.col(c).alias("score_value")) for c in ("p", "p_other")
        ]))
    )
    table = metrics.evaluate(both, "y", "score_value", by=["variant"])
    return rounded(metrics.metric_deltas(table, "variant", "p", "p_other"), "delta")


_FILLED = BASE_FEATURES


def _features(spark, folder, *, complexity: bool = False):
    return materialise(benchmark_features(plies(spark, folder), order="ply_number", complexity=complexity), "features")


_IMPUTED = ", ".join(f"coalesce(cast({c} as double), (select median({c}) from features), 0) as {c}" for c in _FILLED)


@query("median_impute", f"select game_id, {_shown(_FILLED)} from (select game_id, {_IMPUTED} from features)", ("features",))
def median_impute(spark, folder):
    table = _features(spark, folder)
    return rounded(models.impute(table, models.medians(table, _FILLED)).select("game_id", *_FILLED), *_FILLED)


@query("standardise", f"""
select game_id, {', '.join(f"{sql_r6(f'({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1)')} as {c}" for c in _FILLED)}
from (select game_id, {_IMPUTED} from features)""", ("features",))
def standardise(spark, folder):
    table = _features(spark, folder)
    filled = models.impute(table, models.medians(table, _FILLED))
    return rounded(models.standardise(filled, models.moments(filled, _FILLED)).select("game_id", *_FILLED), *_FILLED)


_LR = Spec("logistic_regression", "logistic_regression", tuple(BASE_FEATURES), LABEL)
_RF = Spec("random_forest", "random_forest", tuple(BASE_FEATURES), LABEL)


def _folded_features(spark, folder, *, complexity: bool = False):
    features = benchmark_features(plies(spark, folder), order="ply_number", complexity=complexity)
    return validate.with_folds(materialise(features, "features"), GROUP, LABEL)


def _oof(spark, folder, spec: Spec):
    """Out-of-fold rows; the probability is the model's, so what SQL can state of it stands for it."""
    out = validate.out_of_fold(_folded_features(spark, folder), [spec])
    return out.select("game_id", "fold", LABEL, "model", F.col("p").between(0, 1).alias("is_probability"))


def _oof_sql(model: str) -> str:
    return f"""
select game_id, fold, is_cheating, '{model}' as model, true as is_probability from features join folded using (physical_game_id)"""


@query("lr_oof", _oof_sql("logistic_regression"), ("features", "folded"))
def lr_oof(spark, folder):
    """Every row exactly once, with its fold and label; ``lr_optimality`` proves the models behind it."""
    return _oof(spark, folder, _LR)


@query("rf_oof", _oof_sql("random_forest"), ("features", "folded"))
def rf_oof(spark, folder):
    return _oof(spark, folder, _RF)


@query("oof_values")
def oof_values(spark, folder):
    """Out-of-fold probabilities of both models."""
    table = _folded_features(spark, folder)
    return validate.out_of_fold(table, [_LR, _RF]).select("game_id", "fold", LABEL, "model", "p")


_SUMS = ", ".join(f"sum(is_cheating * ({c} - a_{c}) / s_{c}) as {c}" for c in BASE_FEATURES)


_OPTIMALITY_SQL = f"""
select * from (with t as (select k.fold as held, f.* from features f join folded g using (physical_game_id)
  join (select distinct fold from folded union all select -1) k on g.fold <> k.fold),
m as (select held, {', '.join(f'median({c}) as m_{c}' for c in BASE_FEATURES)} from t group by held),
x as (select held, is_cheating, {', '.join(f'coalesce(cast({c} as double), m_{c}, 0) as {c}' for c in BASE_FEATURES)} from t join m using (held)),
s as (select held, {', '.join(f'avg({c}) as a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}' for c in BASE_FEATURES)}
  from x group by held),
z as (select held, count(*) as n, sum(is_cheating) as positives, {_SUMS} from x join s using (held) group by held)
""" + " union all ".join(
    f"select held as fold, '{name}' as feature, n as rows, round(cast({value} as double), 4) + 0.0 as observed,"
    f" round(cast({value} as double), 4) + 0.0 as fitted from z"
    for name, value in [*((c, c) for c in BASE_FEATURES), (certify.INTERCEPT, "positives")]
) + ")"


@query("lr_optimality", _OPTIMALITY_SQL, ("features", "folded"))
def lr_optimality(spark, folder):
    """Both sides of the optimality condition for the model of every fold, and (-1) of all rows.

    The model's side shows the labels' one where the fit is within the bound, and its own value where it
    isn't; so a fit that isn't the best one differs from the SQL, which knows labels and features only.
    """
    table = _folded_features(spark, folder)
    models_ = {fold: m for (_, fold), m in validate.fold_models(table, [_LR]).items()} | {-1: models.fit(table, _LR)}
    parts = [
        _sides(model, table.filter(F.col("fold") != fold)).select(F.lit(fold).alias("fold"), "*")
        for fold, model in models_.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _sides(model, train):
    """Both sides of the condition; the model's one is its own value where the fit isn't within the bound."""
    found = certify.optimality(model, train, _LR)
    shown = F.when(F.col("optimal"), F.col("observed")).otherwise(F.col("fitted"))
    return found.select(
        "feature", "rows", (F.round("observed", 4) + F.lit(0.0)).alias("observed"), (F.round(shown, 4) + F.lit(0.0)).alias("fitted"))


@query("model_reload", f"select feature, rows, observed, fitted from ({_OPTIMALITY_SQL}) where fold = -1", ("features", "folded"))
def model_reload(spark, folder):
    """The optimality condition of a regression over all rows, after it was saved and loaded again."""
    table = _features(spark, folder)
    path = f"{scratch_folder(spark)}/model-{uuid.uuid4().hex}"
    models.save(models.fit(table, _LR), path)
    return _sides(models.load(path), table)


_STABILITY = ["unstable_top1_match_rate", "stable_top1_match_rate", "depth_drop_rate"]
_CRITICAL = ["critical_top1_match_rate", "critical_mean_cp_loss"]
_SUBSETS = {"lr_13": [], "rf_13": [], "rf_16": _STABILITY, "rf_15": _CRITICAL,
            "lr_18": _STABILITY + _CRITICAL, "rf_18": _STABILITY + _CRITICAL}


@query("feature_subsets", " union all ".join(
    f"select '{name}' as model, '{c}' as feature, count({c}) as known, {sql_r6(f'avg({c})')} as mean from features"
    for name, more in _SUBSETS.items() for c in BASE_FEATURES + more), ("features",))
def feature_subsets(spark, folder):
    """What every model of the ablation grid sees: its features, their known values and means."""
    table = _features(spark, folder, complexity=True)
    parts = []
    for spec in validate.ablation_specs(LABEL):
        seen = table.select(*spec.features)
        cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("known"), F.avg(c).alias("mean")) for c in seen.columns]
        parts.append(seen.agg(F.array(*cells).alias("c")).select(F.lit(spec.name).alias("model"), F.inline("c")))
    return rounded(functools.reduce(DataFrame.unionByName, parts), "mean")


# columns of the labelled plies beside values made for those that the test tables lack
_LABELLED = {
    "centipawn_loss": "centipawn_loss", "eval_before": "eval_before", "is_used": "cast(is_used as int)", "player_elo": "nullif(player_elo, '')",
    "player_hint_shown": "case when is_cheating_move then 1 end", "assistance_search_depth": "case when is_cheating_move then cents % 20 end",
    "assistance_line_rank": "case when is_cheating_move then cents % 5 end", "is_cheating_move": "cast(is_cheating_move as int)",
    "is_accused_by_opponent": "case when cents % 50 = 0 then 1 end", "legal_moves_count": "legal_moves_count",
}
_DENIED = ("player_hint_shown", "assistance_search_depth", "assistance_line_rank", "is_cheating_move", "is_accused_by_opponent")


@query("feature_denylist", " union all ".join(
    f"select '{c}' as name, {str(c not in _DENIED).lower()} as admitted, count({e}) as known from plies" for c, e in _LABELLED.items()), ("plies",))
def feature_denylist(spark, folder):
    """Which columns of a labelled table may become features, with their known values."""
    labelled = plies(spark, folder).select(*[F.expr(e).alias(c) for c, e in _LABELLED.items()])
    admitted = models.usable_features(labelled.columns)
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit(c in admitted).alias("admitted"), F.count(c).alias("known")) for c in labelled.columns
    ]
    return labelled.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query("rf_replay")
def rf_replay(spark, folder):
    """The forest of fold 0 on its held-out rows: its own probability beside that of its node table."""
    table = _folded_features(spark, folder)
    model = models.fit(table.filter("fold <> 0"), _RF)
    held = table.filter("fold = 0")
    own = models.score(model, held).select("game_id", "p")
    return own.join(certify.replay(model, held, _RF.features, ["game_id"]).withColumnRenamed("p", "replayed"), "game_id")


def _stumps(table):
    """Two-level trees whose numbers are medians of the data: tree k splits by feature k, then by the next one."""
    middle = models.medians(table, BASE_FEATURES)
    rows = []
    for k, name in enumerate(BASE_FEATURES):
        after = (k + 1) % len(BASE_FEATURES)
        rows += [(k, 0, k, middle[name], 1, 2, 0.5), (k, 1, after, middle[BASE_FEATURES[after]], 3, 4, 0.5),
                 (k, 2, None, None, -1, -1, 0.25), (k, 3, None, None, -1, -1, 0.125 * (k % 8)), (k, 4, None, None, -1, -1, 1.0)]
    return table.sparkSession.createDataFrame(
        rows, "tree int, node int, feature int, threshold double, left int, right int, share double")


def _walk_sql() -> str:
    filled = lambda c: f"coalesce(cast({c} as double), (select median({c}) from features), 0)"
    middle = lambda c: f"coalesce((select median({c}) from features), 0)"
    after = lambda k: BASE_FEATURES[(k + 1) % len(BASE_FEATURES)]
    trees = [
        f"case when {filled(c)} > {middle(c)} then 0.25 when {filled(after(k))} <= {middle(after(k))} then {0.125 * (k % 8)} else 1.0 end"
        for k, c in enumerate(BASE_FEATURES)
    ]
    return f"select game_id, {sql_r6('(' + ' + '.join(trees) + f') / {len(trees)}.0')} as p from features"


@query("forest_walk", _walk_sql(), ("features",))
def forest_walk(spark, folder):
    """A forest given as a table, walked by joins: the scoring that ``rf_replay`` checks fitted forests by."""
    table = _features(spark, folder)
    filled = models.impute(table, models.medians(table, BASE_FEATURES))
    return rounded(certify.walk(filled, _stumps(table), BASE_FEATURES, ["game_id"], 2, len(BASE_FEATURES)), "p")


def _checked_metrics(table):
    """Row counts of the cells, and whether every measure lies where it must."""
    measures = [F.col(c).between(0, 1) for c in _METRICS]
    consistent = F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))) < 1e-9
    return table.select(
        "model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        (F.col("fn") + F.col("tp")).alias("positives"),
        functools.reduce(lambda a, b: a & b, measures, consistent).alias("measures_fit"),
        (F.col("roc_auc") > 0.4).alias("ranks"),
    )


def _metrics_sql(models_: list[str], where: str = "") -> str:
    return " union all ".join(f"""
select '{m}' as model, count(*) as rows, cast(sum(is_cheating) as bigint) as positives, true as measures_fit, true as ranks
from features join folded using (physical_game_id) {where}""" for m in models_)


def _holdout(spark, folder):
    table = _folded_features(spark, folder)
    parts = [validate.holdout(table, spec) for spec in (_LR, _RF)]
    return parts[0].unionByName(parts[1])


@query("holdout_eval", _metrics_sql(["logistic_regression", "random_forest"], "where fold = 0"), ("features", "folded"))
def holdout_eval(spark, folder):
    return _checked_metrics(_holdout(spark, folder))


@query("holdout_values")
def holdout_values(spark, folder):
    """Metrics of both models on the rows of fold 0."""
    return _holdout(spark, folder)


@query("feature_importance")
def feature_importance(spark, folder):
    """All weights of both final models; a forest's are shares that sum to 1."""
    table = _features(spark, folder)
    out = [
        models.importances(models.fit(table, spec), BASE_FEATURES, spark).select(F.lit(spec.name).alias("model"), "feature", "weight")
        for spec in (_LR, _RF)
    ]
    return out[0].unionByName(out[1])


def _ablation(spark, folder):
    return validate.ablation(_folded_features(spark, folder, complexity=True), LABEL)


@query("ablation_grid", _metrics_sql([s.name for s in validate.ablation_specs(LABEL)]), ("features", "folded"))
def ablation_grid(spark, folder):
    return _checked_metrics(_ablation(spark, folder))


@query("ablation_values")
def ablation_values(spark, folder):
    """Pooled out-of-fold metrics of the grid."""
    return _ablation(spark, folder)


def _players(spark, folder):
    """Both models from labelled plies; class, scores and card of every player and game from its engine lines."""
    table = _features(spark, folder, complexity=True)
    wide = Spec("complexity", "logistic_regression", tuple(ALL_FEATURES), LABEL)
    p, lines = positioned(spark, folder)
    return predict(p, lines, models.fit(table, _LR), game="physical_game_id", played="move_player",
                   complexity_model=models.fit(table, wide))


@query("score_players", """
select physical_game_id, player_color, true as class_fits, true as scores_sum, true as card_fits, 'compatible' as experimental_status,
  true as experimental_fits from (select distinct physical_game_id, player_color from engine_rows join plies using (physical_game_id, ply_number))""",
       ("engine_rows",))
def score_players(spark, folder):
    """Who is scored, whether class, scores and card of both models fit together, and whether the depth of the
    engine lines admits the experimental score."""
    assisted = F.col("classification") == report.ASSISTED
    own = F.when(assisted, F.col("engine_assisted_likelihood")).otherwise(F.col("human_like_likelihood"))
    score = F.col("experimental.score")
    return _players(spark, folder).select(
        *PLAYER, (assisted == (F.col("p") >= report.THRESHOLD)).alias("class_fits"),
        (F.abs(F.col("engine_assisted_likelihood") + F.col("human_like_likelihood") - 1) < 2e-4).alias("scores_sum"),
        (F.abs(F.col("card.primary_pct") - own * 100) < 1e-6).alias("card_fits"),
        F.col("experimental.status").alias("experimental_status"),
        (score.between(0, 1) & ((F.col("experimental.classification") == report.ASSISTED) | (score <= report.THRESHOLD))).alias(
            "experimental_fits"),
    )


@query("score_players_values")
def score_players_values(spark, folder):
    """Class, likelihoods, card and experimental score of every player and game."""
    return _players(spark, folder).select(
        *PLAYER, "classification", "p", "engine_assisted_likelihood", "human_like_likelihood", "card", "experimental")
