"""Exact quantiles with linear interpolation, also of columns with unbounded values.

``percentile`` keeps a count per distinct value in one buffer. That is fine for values
with a bounded domain. For others :func:`exact_quantiles` selects by digits: one pass counts
the rows by the leading digits of an order-preserving key, for all columns at once; a second pass
reads only rows that share the leading digits of a wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.ordering import running_totals

#: Steps of the leading digits per factor of e, and pieces that a step is ranked in.
STEPS, PIECES = 64, 1024
#: Above the largest size of a double's logarithm, so that the sign comes first in the key.
OFFSET = 800


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column; missing values and NaN are left out.

    Two passes over ``df``, whatever its size or values. What reaches the driver has at most two rows per
    column and probability. A column without values gives None.
    """
    columns = list(columns)

    def tally(cells: Column, keys: Sequence[str]) -> DataFrame:
        return df.select(F.explode(cells).alias("v")).groupBy(*[f"v.{k}" for k in keys]).agg(F.count(F.lit(1)).alias("n"))

    return dict(zip(columns, _quantiles(tally, columns, 1, list(probabilities)), strict=True))


def quantiles_outside(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], part: str, parts: int
) -> list[dict[str, list[float | None]]]:
    """``exact_quantiles`` of the rows outside each of the parts 0, 1, ... that column ``part`` names.

    Still two passes over ``df``: rows are counted once, under their own part, and the counts go to all other parts.
    """
    columns = list(columns)

    def tally(cells: Column, keys: Sequence[str]) -> DataFrame:
        own = (
            df.select(F.col(part).alias("__part"), F.explode(cells).alias("v"))
            .groupBy("__part", *[f"v.{k}" for k in keys]).agg(F.count(F.lit(1)).alias("n"))
        )
        others = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: k != F.col("__part"))
        spread = own.select(*keys, "n", F.explode(others).alias("__outside"))
        return spread.withColumn("c", F.col("__outside") * len(columns) + F.col("c")).groupBy(*keys).agg(F.sum("n").alias("n"))

    found = _quantiles(tally, columns, parts, list(probabilities))
    return [dict(zip(columns, found[k * len(columns):(k + 1) * len(columns)], strict=True)) for k in range(parts)]


#: Counts of the structs in an array column by some of their fields, as column ``n``.
Tally = Callable[[Column, Sequence[str]], DataFrame]


def _quantiles(tally: Tally, columns: Sequence[str], parts: int, probabilities: Sequence[float]) -> list[list[float | None]]:
    """Quantiles of every column in every part; column ``i`` of part ``k`` has number ``k * len(columns) + i``."""
    out: list[list[float | None]] = [[None] * len(probabilities) for _ in range(parts * len(columns))]
    if not columns:
        return out
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    wanted = _located(tally, values, probabilities)
    found = _selected(tally, values, wanted)
    ends: dict[tuple[int, int], dict[str, float]] = {}
    for row in wanted:
        ends.setdefault((row["c"], row["i"]), {})[row["end"]] = found[row["c"], row["rank"]]
        low_high = ends[row["c"], row["i"]]
        if len(low_high) == 2:
            at = probabilities[row["i"]] * (row["total"] - 1)
            low, high = low_high["low"], low_high["high"]
            out[row["c"]][row["i"]] = low + (high - low) * (at - math.floor(at))
    return out


def _key(value: Column, steps: int) -> Column:
    """A whole number that never decreases with the value: steps of its logarithm, by sign."""
    size = F.greatest(F.least(F.abs(value), F.lit(1.7e308)), F.lit(5e-324))
    step = F.floor((F.log(size) + OFFSET) * steps)
    return F.when(value > 0, step).when(value < 0, -step).when(value == 0, F.lit(0))


def _located(tally: Tally, values: Sequence[Column], probabilities: Sequence[float]) -> list:
    """First pass: for both ranks around each quantile, the leading digits they share and how many rows lie before."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _key(v, STEPS).alias("b")) for i, v in enumerate(values)])
    sizes = tally(F.filter(cells, lambda x: x["b"].isNotNull()), ["c", "b"])
    column = Window.partitionBy("c")  # as many rows as there are steps
    counted = sizes.select(
        "*", F.sum("n").over(column.orderBy("b")).alias("upto"), F.sum("n").over(column).alias("total")
    )
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), round_(F.lit(p) * (F.col("total") - 1)).cast("long").alias("rank"))
        for i, p in enumerate(probabilities) for end, round_ in (("low", F.floor), ("high", F.ceil))
    ])
    return (
        counted.select("c", "b", "n", "upto", "total", F.inline(ranks))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select("c", "i", "end", "b", "rank", (F.col("upto") - F.col("n")).alias("before"), "total").collect()
    )


def _selected(tally: Tally, values: Sequence[Column], wanted: Sequence) -> dict[tuple[int, int], float]:
    """Second pass: the values at the wanted ranks, by column and rank.

    Rows with the wanted digits are counted per distinct value before they are ranked, and each step is ranked
    in pieces, so neither ties nor a wide step meet in one task.
    """
    steps: dict[int, dict[int, tuple[int, set[int]]]] = {}
    for row in wanted:
        steps.setdefault(row["c"], {}).setdefault(row["b"], (row["before"], set()))[1].add(row["rank"])
    if not steps:
        return {}
    held, ranks = [], []
    for i, value in enumerate(values):
        digits = _key(value, STEPS)
        some = sorted({b for c, own in steps.items() if c % len(values) == i for b in own})
        if some:
            held.append(F.when(digits.isin(some), F.struct(F.lit(i).alias("c"), digits.alias("b"), value.alias("value"))))
    for c, own in steps.items():
        ranks += [F.struct(F.lit(c).alias("wc"), F.lit(b).cast("long").alias("wb"), F.lit(before).cast("long").alias("before"),
                           F.array(*[F.lit(r).cast("long") for r in sorted(inside)]).alias("ranks"))
                  for b, (before, inside) in own.items()]
    distinct = tally(F.filter(F.array(*held), lambda x: x.isNotNull()), ["c", "b", "value"])
    ranked = running_totals(distinct, ["c", "b"], ["value"], _key(F.col("value"), STEPS * PIECES), {"upto": "n"})
    # a step may be wanted of one part only
    own = F.get(F.filter(F.array(*ranks), lambda x: (x["wc"] == F.col("c")) & (x["wb"] == F.col("b"))), F.lit(0))
    hit = ranked.withColumn("own", own).select(
        "c", "value", F.explode(F.filter("own.ranks", lambda r: (r < F.col("own.before") + F.col("upto"))
                                         & (r >= F.col("own.before") + F.col("upto") - F.col("n")))).alias("rank")
    )
    return {(r["c"], r["rank"]): r["value"] for r in hit.collect()}
