"""Presentation of scores: classes, cards, depth gate, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import as_column, round_exact

# Class names, threshold, labels and the depth the complexity models need.
ASSISTED, HUMAN = "engine-assisted", "human-like"
THRESHOLD = 0.5
ASSIST_LABEL, HUMAN_LABEL = "Engine-assistance score", "Human-like score"
REQUIRED_DEPTH = 15


def classify(df: DataFrame, probability: str = "p") -> DataFrame:
    """Class name and the two complementary scores, rounded to 4 decimals."""
    p = F.col(probability)
    return df.select(
        "*",
        F.when(p >= THRESHOLD, ASSISTED).when(p.isNotNull(), HUMAN).alias("classification"),
        F.round(p, 4).alias("engine_assisted_likelihood"),
        F.round(1 - p, 4).alias("human_like_likelihood"),
    )


def player_card(classification: Column | str, assisted: Column | str, human: Column | str) -> Column:
    """Card of a player: the score of the class shown first, the other one second."""
    is_assisted = F.lower(as_column(classification)) == ASSISTED
    a, h = as_column(assisted), as_column(human)

    def pick(yes, no) -> Column:
        return F.when(is_assisted, yes).otherwise(no)

    return F.struct(
        is_assisted.alias("is_assisted"),
        pick("ENGINE-ASSISTED", "HUMAN-LIKE").alias("badge_text"),
        pick("badge-assisted", "badge-human").alias("badge_class"),
        pick(ASSIST_LABEL, HUMAN_LABEL).alias("primary_label"),
        (pick(a, h) * 100).alias("primary_pct"),
        pick(a, h).alias("primary_prob"),
        pick("score-assisted", "score-human").alias("primary_color_class"),
        pick(HUMAN_LABEL, ASSIST_LABEL).alias("secondary_label"),
        (pick(h, a) * 100).alias("secondary_pct"),
        pick(h, a).alias("secondary_prob"),
        (a * 100).alias("assist_pct"),
        (h * 100).alias("human_pct"),
    )


def depth_gate(df: DataFrame, probability: str, depth: Column | str, *, require: bool = True) -> DataFrame:
    """Score of the complexity model only where the analysis depth fits.

    With ``require`` off a score at another depth is kept and marked as unverified.
    """
    fits = as_column(depth) == REQUIRED_DEPTH
    keep = fits if require else F.lit(True)
    p = F.col(probability)
    return df.select(
        "*",
        fits.alias("is_depth_compatible"),
        F.when(fits, "compatible").otherwise("incompatible_depth" if require else "unverified_depth").alias("status"),
        F.lit(REQUIRED_DEPTH).alias("required_depth"),
        F.when(keep, F.round(p, 4)).alias("score"),
        F.when(keep, F.when(p >= THRESHOLD, ASSISTED).when(p.isNotNull(), HUMAN)).alias("classification"),
    )


def display_value(value: Column | str, name: str) -> Column:
    """``N/A`` for missing, whole numbers as they are, percent for rates, two decimals otherwise.

    Decimals are rounded half to even on the binary value, so 6.25 % shows as 6.2 %.
    """
    x = as_column(value)
    number = x.cast("double")
    if "rate" in name:
        text = F.format_string("%.1f%%", round_exact(number * 100, 1))
    else:
        text = F.format_string("%.2f", round_exact(number, 2))
    whole = F.typeof(x).isin("tinyint", "smallint", "int", "bigint")
    return F.when(x.isNull() | F.isnan(number), "N/A").when(whole, x.cast("string")).otherwise(text)


def alias_both_ways(df: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """Give both names of a pair where only one is present."""
    pairs = pairs or {"player": "player_color", "ply": "ply_number"}
    for a, b in pairs.items():
        if b in df.columns and a not in df.columns:
            df = df.withColumn(a, F.col(b))
        elif a in df.columns and b not in df.columns:
            df = df.withColumn(b, F.col(a))
    return df
