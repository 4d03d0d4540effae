"""Pipelines whose preprocessing is plain SQL, so a fitted one saves and loads as a unit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.quantiles import exact_quantiles, quantiles_outside
from turnwise.schemas import LABEL_BEARING

VECTOR = "features_vector"

# Hyperparameters of the published baselines.
SEED = 42
TREES, TREE_DEPTH = 100, 6
MAX_ITER = 1000
INVERSE_REGULARISATION = 1.0


@dataclass(frozen=True)
class Spec:
    """What to fit: ``kind`` is ``logistic_regression`` or ``random_forest``."""

    name: str
    kind: str
    features: tuple[str, ...]
    label: str = "is_cheating"


def check_features(features: Sequence[str]) -> None:
    leaking = sorted(set(features) - set(usable_features(features)))
    if leaking:
        raise ValueError(f"label-bearing columns cannot be features: {leaking}")


def usable_features(columns: Sequence[str]) -> list[str]:
    """The columns that may become features: those that don't carry the label, in their order."""
    return [c for c in columns if c not in LABEL_BEARING]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Interpolated median per column; 0.0 for a column without values."""
    found = exact_quantiles(df, columns, [0.5])
    return {c: 0.0 if q[0] is None else float(q[0]) for c, q in found.items()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


@dataclass(frozen=True)
class Preparation:
    """Medians, moments of the filled features, and row count of a training set."""

    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    rows: int


def prepare(train: DataFrame, features: Sequence[str]) -> Preparation:
    fill = medians(train, features)
    filled = impute(train.select(*features), fill)
    return Preparation(fill, moments(filled, features), train.count())


def prepare_folds(table: DataFrame, features: Sequence[str], folds: int) -> list[Preparation]:
    """The preparation of every fold's training rows, all in one set of passes over the table."""
    found = quantiles_outside(table, features, [0.5], "fold", folds)
    fill = [{c: 0.0 if q[0] is None else float(q[0]) for c, q in own.items()} for own in found]
    # a row is copied for every fold that trains on it; an aggregate per fold and feature would be too wide to compile
    training = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    filled = table.select(F.explode(training).alias("__k"), *features).select("__k", *[
        F.coalesce(F.col(c).cast("double"), F.get(F.array(*[F.lit(own[c]) for own in fill]), F.col("__k"))).alias(c)
        for c in features
    ])
    scale = filled.groupBy("__k").agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
    )
    rows = {row["__k"]: row for row in scale.collect()}
    return [
        Preparation(
            fill[k],
            {c: (rows[k][f"m_{c}"] or 0.0, rows[k][f"s_{c}"] or 1.0) if k in rows else (0.0, 1.0) for c in features},
            rows[k]["__n"] if k in rows else 0,
        )
        for k in range(folds)
    ]


def fit(train: DataFrame, spec: Spec, preparation: Preparation | None = None) -> PipelineModel:
    """Fit on ``train``; imputation and scaling parameters come from it alone.

    ``preparation`` holds them if they are known already. The fitted preprocessing is one SQL
    projection with literal parameters.
    """
    features = list(spec.features)
    check_features(features)
    known = preparation or prepare(train, features)
    fill, scale = known.fill, known.scale
    prepared = {c: f"coalesce(cast({c} as double), {fill[c]!r}D)" for c in features}
    if spec.kind == "logistic_regression":
        prepared = {c: f"(({e}) - {scale[c][0]!r}D) / {scale[c][1]!r}D" for c, e in prepared.items()}
    columns = ", ".join(f"{e} AS prepared_{c}" for c, e in prepared.items())
    project = SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"prepared_{c}" for c in features], outputCol=VECTOR)
    vectors = assemble.transform(project.transform(train)).select(VECTOR, spec.label)
    return PipelineModel([project, assemble, _estimator(spec, known.rows).fit(vectors)])


def _estimator(spec: Spec, rows: int):
    shared = {"featuresCol": VECTOR, "labelCol": spec.label}
    if spec.kind == "logistic_regression":
        # Spark averages the loss over rows; the penalty must shrink with them
        rows = max(rows, 1)
        return LogisticRegression(
            maxIter=MAX_ITER, regParam=1.0 / (INVERSE_REGULARISATION * rows), elasticNetParam=0.0,
            standardization=False, **shared,
        )
    if spec.kind == "random_forest":
        # with the node of every row and tree kept from level to level, no level walks the trees from their roots
        return RandomForestClassifier(
            numTrees=TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="sqrt", seed=SEED, cacheNodeIds=True, **shared
        )
    raise ValueError(f"unknown model kind {spec.kind!r}")


def score(model: PipelineModel, df: DataFrame, *, probability: str = "p") -> DataFrame:
    """Probability of class 1 for every row; its place comes from the model's classes."""
    classes = int(model.stages[-1].numClasses)
    if classes != 2:
        raise ValueError(f"a two-class model is needed, this one has {classes}")
    added = model.transform(df)
    return added.select(*df.columns, vector_to_array("probability")[1].alias(probability))


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Weight of each feature, most important first: tree importances or coefficients."""
    last = model.stages[-1]
    vector = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, float(w)) for f, w in zip(features, vector.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.desc("weight"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
