"""Exploration tables: group comparison, description, correlation, histograms, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import as_column
from turnwise.operators.quantiles import exact_quantiles
from turnwise.session import materialise

QUARTILES = [0.25, 0.5, 0.75]
UNRANKED = "Unranked (>5)"


def compare_groups(df: DataFrame, by: str, *, count: str = "ply_number", loss: str = "centipawn_loss",
                   hit: str = "is_engine_top1") -> DataFrame:
    """Count, mean and median loss, and match rate per group; the loss has a bounded domain."""
    return df.groupBy(by).agg(
        F.count(count).alias("total_moves"),
        F.avg(loss).alias("mean_cp_loss"),
        F.median(loss).alias("median_cp_loss"),
        F.avg(hit).alias("top1_match_rate"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max; one row per column."""
    df = materialise(df.select(*columns), "described")  # three passes read it
    quartiles = exact_quantiles(df, columns, QUARTILES)
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    *[
                        F.lit(q).cast("double").alias(f"p{round(p * 100)}")
                        for p, q in zip(QUARTILES, quartiles[c])
                    ],
                    F.max(c).cast("double").alias("max"),
                )
                for c in columns
            ]
        ).alias("rows")
    )
    return row.select(F.inline("rows"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form; a pair skips the rows where either side is missing."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        value = F.col(f"`{a}|{b}`")
        cells.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), value.alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), value.alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def rank_distribution(df: DataFrame, rank: str = "played_move_rank_top5") -> DataFrame:
    label = F.coalesce(F.col(rank).cast("string"), F.lit(UNRANKED))
    return df.groupBy(label.alias("rank")).agg(F.count(F.lit(1)).alias("moves")).orderBy("rank")


def iqr_fence(df: DataFrame, value: str) -> DataFrame:
    """One row with exact quartiles and the upper fence; the values' domain may be unbounded."""
    q25, q75 = exact_quantiles(materialise(df.select(value), "fenced"), [value], [0.25, 0.75])[value]
    row = df.sparkSession.createDataFrame([(q25, q75)], "q25 double, q75 double")
    return row.select("*", (F.col("q75") - F.col("q25")).alias("iqr"),
                      (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("upper_bound"))


def outliers(df: DataFrame, value: str = "centipawn_loss") -> DataFrame:
    """Rows above Q3 + 1.5 IQR; the fence enters as a scalar subquery."""
    return df.filter(F.col(value) > iqr_fence(df, value).select("upper_bound").scalar())


def first_outliers(df: DataFrame, k: int = 5, *, value: str = "centipawn_loss",
                   order: Sequence[str] = ("game_id", "ply_number")) -> DataFrame:
    """The first ``k`` outliers in row order."""
    return outliers(df, value).orderBy(*order).limit(k)


def histogram(df: DataFrame, value: str, bins: int, *, low: Column | None = None, high: Column | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts; a bin holds its left edge and the last one also its right edge.

    Without bounds the range is that of the data, read by a scalar subquery; a column of
    one value gets the range half a unit to either side.
    """
    x = as_column(value).cast("double")
    if low is None or high is None:
        span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        flat = F.col("lo") == F.col("hi")
        low = span.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).scalar()
        high = span.select(F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))).scalar()
    placed = df.filter(x.isNotNull()).select(*by, x.alias("x"), low.alias("lo"), high.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return (
        placed.filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        .groupBy(*by, index.alias("bin"), (F.col("lo") + index * width).alias("left_edge"),
                 (F.col("lo") + (index + 1) * width).alias("right_edge"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def loss_histogram(df: DataFrame, *, value: str = "centipawn_loss", by: Sequence[str] = ("player_color",)) -> DataFrame:
    """14 bins over [0, min(300, max(largest, 50))] per group; larger losses fall outside."""
    top = df.agg(
        F.least(F.lit(300.0), F.greatest(F.max(value).cast("double"), F.lit(50.0))).alias("top")
    ).scalar()
    return histogram(df, value, 14, low=F.lit(0.0), high=top, by=by)


def boxplot(df: DataFrame, by: str, value: str = "centipawn_loss") -> DataFrame:
    """Quartiles, whiskers (last values inside 1.5 IQR) and outlier counts per group.

    Works on counts per distinct value, so the data shuffles once in reduced form. The
    value must have a bounded domain.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    quartiles = counts.groupBy(by).agg(
        F.percentile(value, F.array(*[F.lit(p) for p in QUARTILES]), F.col("n")).alias("q")
    ).select(
        by,
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("__lo"),
        (F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("__hi"),
    )
    inside = F.col(value).between(F.col("__lo"), F.col("__hi"))
    return (
        counts.join(quartiles, by)
        .groupBy(by, "q1", "med", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def loss_trajectory(df: DataFrame, *, game: str = "game_id", color: str = "player_color",
                    ply: str = "ply_number", loss: str = "centipawn_loss") -> DataFrame:
    """Scored plies of each colour in ply order within their game, with the blunder mark of the chart."""
    return (
        df.filter(F.col(loss).isNotNull() & F.lower(color).isin("white", "black"))
        .select(game, F.lower(color).alias("series"), ply, loss, (F.col(loss) > 200).alias("over_blunder_line"))
        .repartition(game)
        .sortWithinPartitions(game, "series", ply)
    )


def color_plies(df: DataFrame, color: str, column: str = "player_color") -> DataFrame:
    return df.filter(F.lower(column) == color.lower())


def side_by_side(profiles: DataFrame, features: Sequence[str], *, game: str = "game_id",
                 color: str = "player_color") -> DataFrame:
    """One row per game and feature with both players' values."""
    return _by_side(profiles, {f: F.col(f).cast("double") for f in features}, "feature", game, color)


def _by_side(df: DataFrame, measures: dict[str, Column], name: str, game: str, color: str) -> DataFrame:
    """White and black value of each measure per game; rows multiply only after the shuffle."""
    side = F.lower(color)
    wide = df.groupBy(game).agg(*[
        F.struct(*[F.max(F.when(side == s, value)).alias(s) for s in ("white", "black")]).alias(label)
        for label, value in measures.items()
    ])
    cells = [F.struct(F.lit(m).alias(name), wide[f"`{m}`"]["white"].alias("white"), wide[f"`{m}`"]["black"].alias("black"))
             for m in measures]
    return wide.select(game, F.inline(F.array(*cells)))


# Labels of the quality breakdown and the feature behind each.
BREAKDOWN = {
    "Top-1 Engine Match": "top1_match_rate",
    "Excellent (<=25 cp)": "excellent_rate",
    "Inaccuracy (50-100 cp)": "inaccuracy_rate",
    "Mistake (100-200 cp)": "mistake_rate",
    "Blunder (>200 cp)": "blunder_rate",
}


def quality_breakdown(features: DataFrame, *, game: str = "game_id", color: str = "player_color") -> DataFrame:
    """Percent per quality category and side, missing as 0.0, rounded to one decimal."""
    percent = {
        label: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 1) for label, c in BREAKDOWN.items()
    }
    zero = F.lit(0.0)
    return _by_side(features, percent, "category", game, color).select(
        game, "category", F.coalesce("white", zero).alias("white_pct"), F.coalesce("black", zero).alias("black_pct")
    )
