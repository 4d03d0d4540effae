"""Group-wise stratified folds and their leakage checks."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.numeric import rate
from turnwise.operators.ordering import running_totals
from turnwise.session import materialise

#: Lots in which the groups of one stratum are handed out, at most.
LOTS = 1000


def assign_folds(df: DataFrame, group: str, label: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold 0..folds-1 per group; every group lands in one fold, strata are spread evenly.

    Groups with equal (rows, positives) form a stratum. Its groups are dealt in hash
    order, each stratum from its own start. Dealing is a running count over hash
    buckets, so a stratum of all groups does not meet in one task.
    """
    dealt = _dealt(_strata(df, group, label, seed), group)
    fold = (F.col("__at") - 1 + F.col("rows") + F.col("positives")) % folds
    return dealt.select(group, "rows", "positives", fold.cast("int").alias("fold"))


def balanced_folds(df: DataFrame, group: str, label: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """Like ``assign_folds``, with folds as even as a greedy choice makes them, also for few large groups.

    The strata, those that weigh most first, are handed out group by group, each to the fold where it
    adds least to the squares of both labels' shares. The driver holds the histogram of (rows,
    positives) only; which groups of a stratum go where is their hash order. A stratum of more than
    ``LOTS`` groups goes out in that many lots.
    """
    groups = materialise(_strata(df, group, label, seed), "groups")
    cells = groups.groupBy("rows", "positives").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = deal([tuple(c) for c in cells], folds)
    ends = [(rows, positives, [sum(share[:k]) for k in range(1, folds)]) for (rows, positives), share in shares.items()]
    table = df.sparkSession.createDataFrame(ends, "rows bigint, positives bigint, __ends array<bigint>")
    fold = F.size(F.filter("__ends", lambda end: end < F.col("__at")))
    return _dealt(groups, group).join(table, ["rows", "positives"]).select(
        group, "rows", "positives", fold.cast("int").alias("fold"))


def deal(cells: Iterable[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], list[int]]:
    """Groups per fold of every cell (rows, positives, groups); whole numbers, so the same everywhere."""
    cells = list(cells)
    positives = sum(p * n for _, p, n in cells)
    negatives = sum((r - p) * n for r, p, n in cells)

    def weight(cell):
        r, p, _ = cell
        return -((p * negatives) ** 2 + ((r - p) * positives) ** 2), -r, -p

    load = [(0, 0)] * folds
    out = {}
    for r, p, n in sorted(cells, key=weight):
        def cost(fold):
            pos, neg = load[fold]
            return pos * p * negatives**2 + neg * (r - p) * positives**2, pos + neg, fold  # noqa: B023

        share, size = [0] * folds, -(-n // LOTS)
        heap = [cost(fold) for fold in range(folds)]
        heapq.heapify(heap)
        for start in range(0, n, size):
            fold, lot = heap[0][2], min(size, n - start)
            share[fold] += lot
            load[fold] = load[fold][0] + p * lot, load[fold][1] + (r - p) * lot
            heapq.heapreplace(heap, cost(fold))
        out[r, p] = share
    return out


def _strata(df: DataFrame, group: str, label: str, seed: int) -> DataFrame:
    """Groups with rows and positives, and the digest that orders them."""
    digest = F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("positives")
    ).select("*", digest.alias("__digest"), F.lit(1).alias("__one"))


def _dealt(groups: DataFrame, group: str) -> DataFrame:
    """Place of a group in its stratum, from 1 in hash order."""
    return running_totals(
        groups, ["rows", "positives"], ["__digest", group], F.substring("__digest", 1, 3), {"__at": "__one"}
    )


def fold_summary(groups: DataFrame, group: str) -> DataFrame:
    """Rows, groups and positive rate of both sides of each fold, and the group overlap.

    Takes one row per (group, fold): a group in two folds counts as overlap in both.
    """
    per_group = groups.groupBy(group).agg(
        F.count_distinct("fold").alias("__folds"), F.min("fold").alias("__first")
    )
    per_fold = groups.join(per_group, group).groupBy("fold").agg(
        F.sum("rows").alias("val_rows"),
        F.count(F.lit(1)).alias("val_groups"),
        F.sum("positives").alias("__pos"),
        F.count_if(F.col("__folds") > 1).alias("overlap_groups"),
        F.count_if(F.col("__first") == F.col("fold")).alias("__new"),
    )
    # one row per fold from here on
    everything = Window.partitionBy()
    rows, positives = F.sum("val_rows").over(everything), F.sum("__pos").over(everything)
    all_groups = F.sum("__new").over(everything)
    train_rows = rows - F.col("val_rows")
    return per_fold.select(
        "fold",
        train_rows.alias("train_rows"),
        "val_rows",
        (all_groups - F.col("val_groups") + F.col("overlap_groups")).alias("train_groups"),
        "val_groups",
        rate(positives - F.col("__pos"), train_rows).alias("train_positive_rate"),
        rate(F.col("__pos"), F.col("val_rows")).alias("val_positive_rate"),
        "overlap_groups",
    )


def leakage(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups per fold that also have rows in other folds; 0 throughout means no leak."""
    # a set per group holds at most one entry per fold
    spread = rows.groupBy(group).agg(F.collect_set(fold).alias("__folds"))
    return spread.select(F.size("__folds").alias("__n"), F.explode("__folds").alias(fold)).groupBy(fold).agg(
        F.count(F.lit(1)).alias("val_groups"), F.count_if(F.col("__n") > 1).alias("overlap_groups")
    )


def require_no_leak(rows: DataFrame, group: str, fold: str = "fold") -> None:
    worst = leakage(rows, group, fold).agg(F.coalesce(F.max("overlap_groups"), F.lit(0))).first()[0]
    if worst:
        raise RuntimeError(f"group leakage between folds: {worst} overlapping groups in one fold")
