"""Comparison of rows with label cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import share


def _long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
        ])),
    )


def cohort_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each feature per label; one pass, then unpivot."""
    wide = df.groupBy(label).agg(
        *[F.struct(F.avg(f).alias("mean"), F.stddev_samp(f).alias("std")).alias(f) for f in features]
    )
    return wide.select(
        label,
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f)["mean"].alias("mean"), F.col(f)["std"].alias("std"))
            for f in features
        ])),
    )


def cohort_distance(df: DataFrame, keys: Sequence[str], label: str, features: Sequence[str]) -> DataFrame:
    """Distance of every row from both cohorts in cohort deviations, per feature.

    The cohorts are the labels 0 and 1, so the joined side has at most two rows per
    feature whatever the data.
    """
    stats = cohort_stats(df.filter(F.col(label).isin(0, 1)), label, features).groupBy("feature").agg(*[
        F.max(F.when(F.col(label) == side, F.col(m))).alias(f"{m}{side}") for side in (0, 1) for m in ("mean", "std")
    ])
    joined = _long(df, keys, features).join(F.broadcast(stats), "feature")
    z = [
        ((F.col("value") - F.col(f"mean{s}")) / F.when(F.col(f"std{s}") > 0, F.col(f"std{s}"))).alias(f"z{s}")
        for s in (0, 1)
    ]
    return joined.select(*keys, "feature", "value", *z)


def stability(plies: DataFrame, label: str, *, shallow: str, deep: str, played: str) -> DataFrame:
    """Share of stable used plies and agreement on either kind, pooled over plies per label."""
    stable = F.coalesce(F.col(shallow) == F.col(deep), F.lit(False))
    hit = F.coalesce(F.col(played) == F.col(deep), F.lit(False))
    return plies.filter(F.col("is_used")).groupBy(label).agg(
        F.count(F.lit(1)).alias("plies"),
        share(stable).alias("stable_share"),
        share(hit, stable).alias("stable_match"),
        share(hit, ~stable).alias("unstable_match"),
    )


def score_contributions(
    df: DataFrame, keys: Sequence[str], coefficients: Mapping[str, float],
    centers: Mapping[str, float], scales: Mapping[str, float], intercept: float,
) -> DataFrame:
    """Linear score by feature: scaled value times coefficient, and the sum as log-odds.

    Row by row; a missing value counts as the centre and adds nothing.
    """
    def part(f: str) -> Column:
        scaled = (F.coalesce(F.col(f).cast("double"), F.lit(centers[f])) - centers[f]) / scales[f]
        return scaled * coefficients[f]

    parts = {f: part(f) for f in coefficients}
    log_odds = F.lit(float(intercept))
    for column in parts.values():
        log_odds = log_odds + column
    cells = [F.struct(F.lit(f).alias("feature"), c.alias("contribution")) for f, c in parts.items()]
    return df.select(
        *keys, log_odds.alias("log_odds"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))).alias("probability"),
        F.inline(F.array(*cells)),
    )
