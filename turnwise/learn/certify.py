"""Checks of fitted models that don't trust the fit: optimality of a regression, replay of a forest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.learn.models import INVERSE_REGULARISATION, Spec, save
from turnwise.session import scratch_folder

INTERCEPT = "(intercept)"
#: Largest mean gradient of a fit that counts as optimal.
MEAN_GRADIENT = 2e-5
#: Node tables up to this many rows are broadcast; beyond it Spark joins as it sees fit.
BROADCAST_NODES = 200_000


def optimality(model: PipelineModel, train: DataFrame, spec: Spec) -> DataFrame:
    """The condition that only the best penalised fit meets, per feature and for the intercept.

    With standardised features x, labels y, probabilities p and weights w, the gradient of
    ``sum of log losses + |w|^2 / (2 C)`` vanishes where ``sum(p x) + w / C`` equals ``sum(y x)``. One
    aggregate over the training rows gives both: ``observed`` is the labels' side, ``fitted`` the
    model's, ``residual`` their difference, and ``optimal`` says whether its mean is within the bound.
    """
    last = model.stages[-1]
    x = [F.col(f"prepared_{c}") for c in spec.features] + [F.lit(1.0)]
    penalty = [float(w) / INVERSE_REGULARISATION for w in last.coefficients] + [0.0]
    y, p = F.col(spec.label).cast("double"), F.col("__p")
    # the preparation's columns stand beside the probability
    scored = model.transform(train).withColumn("__p", vector_to_array("probability")[1])
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.sum(y * v).alias("observed"), (F.sum(p * v) + F.lit(w)).alias("fitted"),
                 F.count(y).alias("rows"))
        for name, v, w in zip((*spec.features, INTERCEPT), x, penalty, strict=True)
    ])
    residual = F.col("fitted") - F.col("observed")
    return scored.agg(cells.alias("cells")).select(F.inline("cells")).select(
        "*", residual.alias("residual"), (F.abs(residual) <= F.col("rows") * MEAN_GRADIENT).alias("optimal")
    )


def forest_nodes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """A fitted forest as a table: tree, node, feature (its place), threshold, left, right, and the share of class 1.

    Leaves have no feature. The table is what Spark itself saves of a forest, read back in the session of ``rows``.
    """
    spark = rows.sparkSession
    path = f"{scratch_folder(spark)}/forest-{uuid.uuid4().hex}"
    save(model.stages[-1], path)
    node, inner = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    stats = node["impurityStats"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        (F.get(stats, F.lit(1)) / (F.get(stats, F.lit(0)) + F.get(stats, F.lit(1)))).alias("share"),
    )


def replay(model: PipelineModel, rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys`` and the forest's probability, by its node table instead of its own scoring."""
    prepared = model.stages[0].transform(rows)
    forest = model.stages[-1]
    nodes = forest_nodes(model, rows)
    return walk(prepared, nodes, [f"prepared_{c}" for c in features], keys, forest.getMaxDepth(), forest.getNumTrees)


def walk(rows: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str], depth: int, trees: int) -> DataFrame:
    """Mean share of class 1 over all trees as ``p``, per key: every row goes down every tree, a join a level."""
    keys = list(keys)
    held = F.broadcast(nodes) if trees * 2 ** (depth + 1) <= BROADCAST_NODES else nodes
    state = rows.select(
        *keys, F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"),
    )
    for _ in range(depth):
        below = F.when(F.col("feature").isNull(), F.col("node")).when(
            F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")
        ).otherwise(F.col("right"))
        state = state.join(held, ["tree", "node"]).select(*keys, "x", "tree", below.alias("node"))
    return state.join(held, ["tree", "node"]).groupBy(*keys).agg((F.sum("share") / trees).alias("p"))
