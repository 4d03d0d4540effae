"""Labelled plies to cross-validated models, final fits and their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.learn import models, validate
from turnwise.learn.models import Spec
from turnwise.operators import audit, folds
from turnwise.operators.features import benchmark_features
from turnwise.schemas import ALL_FEATURES, BASE_FEATURES
from turnwise.session import materialise
from turnwise.sources import sinks

GROUP, LABEL = "physical_game_id", "is_cheating"


@dataclass(frozen=True)
class TrainingResult:
    pooled: DataFrame
    per_fold: DataFrame
    folds: DataFrame
    balance: DataFrame
    models: dict[str, PipelineModel]
    weights: dict[str, DataFrame]
    totals: DataFrame
    columns: tuple[str, ...]
    n_folds: int
    seed: int


def train(plies: DataFrame, *, order: str = "half_move", complexity: bool = False, n_folds: int = 5,
          seed: int = 42) -> TrainingResult:
    """Grouped cross validation of both models, then final fits on every row."""
    columns = tuple(ALL_FEATURES if complexity else BASE_FEATURES)
    features = benchmark_features(plies, order=order, complexity=complexity)
    table = validate.with_folds(features, GROUP, LABEL, folds=n_folds, seed=seed, balanced=True)
    specs = [Spec(kind, kind, columns, LABEL) for kind in ("logistic_regression", "random_forest")]
    predictions = materialise(
        validate.out_of_fold(table, specs, folds=n_folds).select("model", "fold", "game_id", LABEL, "p"), "oof"
    )
    pooled, per_fold = validate.evaluate_models(predictions, LABEL)
    groups = table.groupBy(GROUP, "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(LABEL).alias("positives")
    )
    fitted = {s.name: models.fit(table, s) for s in specs}
    weights = {n: models.importances(m, columns, table.sparkSession) for n, m in fitted.items()}
    return TrainingResult(
        pooled, per_fold, folds.fold_summary(groups, GROUP), audit.class_balance(table, LABEL), fitted, weights,
        table.agg(F.count(F.lit(1)).alias("player_games"), F.count_distinct(GROUP).alias("groups")), columns, n_folds, seed,
    )


def save(result: TrainingResult, folder: str) -> None:
    """Models, and the report as one JSON document of nested columns.

    Every part of the report has a bounded number of rows: models, folds, features.
    """
    for name, model in result.models.items():
        models.save(model, f"{folder}/{name}")
    sinks.write_document(report(result), f"{folder}/model_metadata")


def report(result: TrainingResult) -> DataFrame:
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    split = F.struct(
        F.lit(f"stratified folds of whole groups by {GROUP}, {result.n_folds} folds").alias("strategy"),
        F.lit(result.seed).alias("random_state"), F.lit(result.n_folds).alias("n_splits"),
    )
    out = result.balance.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), split.alias("split"),
        result.totals.select(F.struct("*").alias("t")).scalar().alias("totals"),
        F.array(*map(F.lit, result.columns)).alias("feature_columns"),
        F.struct(*result.balance.columns).alias("class_balance"),
    )
    parts = {"models": result.pooled, "cv_fold_metrics": result.per_fold, "folds_summary": result.folds}
    parts |= {f"{n}_weights": w.select("weight", "feature") for n, w in result.weights.items()}
    return out.select("*", *[packed(df, n).scalar().alias(n) for n, df in parts.items()])
