"""Ordered numbering and running totals that hold up under hot keys.

A plain ``row_number()`` or running ``sum()`` puts all rows of a key into one
task. Both operators here cut a key into ordered buckets, total each bucket with
a map-side combined aggregate, and add the total of the earlier buckets to a
window that only spans one bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.numeric import as_column

_BUCKET = "__bucket"
_HOT = "__hot"
_OFFSET = "__offset"

#: A key with more rows than this is cut into pieces; numbers are the same either way.
HOT_ROWS = 1_000_000


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str,
    *,
    spread: Column | str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number rows from 1 within ``keys`` in the order of ``order_by``; NULL is a key like any other.

    ``spread`` cuts a hot key into pieces. It must never decrease along the order: a date, or a
    struct of leading order columns with the last one coarsened, so that a day with most of the
    rows is cut as well. Each piece is numbered by one task, and the piece totals of a key meet in
    one. The order should be total, as for any ``row_number``.
    """
    keys, order_by = list(keys), list(order_by)
    spread = as_column(spread)

    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > hot_rows)
        .select(*keys, F.lit(True).alias(_HOT))
    )
    # at most one key per ``hot_rows`` rows
    marked = null_safe_join(df, F.broadcast(hot), keys, "left").withColumn(_BUCKET, F.when(F.col(_HOT), spread))
    offsets = _earlier_totals(
        marked.filter(F.col(_HOT)).groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias(_OFFSET)),
        keys,
        [_OFFSET],
    )
    # a piece's offset goes ahead of its rows as a row of its own, so the rows needn't be dealt out for a join as well
    both = marked.drop(_HOT).withColumn(_OFFSET, F.lit(None).cast("bigint")).unionByName(offsets, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(_OFFSET).asc_nulls_last(), *order_by)
    ahead = F.first(_OFFSET).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return (
        both.withColumn(name, F.row_number().over(inside) + F.coalesce(ahead, F.lit(0)))
        .filter(F.col(_OFFSET).isNull())
        .select(*df.columns, F.col(name).cast("bigint").alias(name))
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str],
    bucket: Column,
    totals: Mapping[str, str],
) -> DataFrame:
    """Inclusive running sums within ``keys`` along ``order_by``.

    ``totals`` maps new column names to the summed columns. ``bucket`` must never
    decrease along the order, and its number of values must be bounded: the bucket
    totals of a key meet in one task.
    """
    keys = list(keys)
    offset_names = {new: f"__before_{new}" for new in totals}
    marked = df.withColumn(_BUCKET, bucket)
    per_bucket = marked.groupBy(*keys, _BUCKET).agg(
        *[F.sum(src).alias(offset_names[new]) for new, src in totals.items()]
    )
    offsets = _earlier_totals(per_bucket, keys, list(offset_names.values()))
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return null_safe_join(marked, offsets, [*keys, _BUCKET]).select(
        *df.columns,
        *[
            (F.sum(src).over(inside) + F.col(offset_names[new])).alias(new)
            for new, src in totals.items()
        ],
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet; the columns of ``left``, then what ``right`` adds."""
    added = [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *added)
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, same, how).select(*left.columns, *added)


def _earlier_totals(per_bucket: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace each bucket total with the sum over the key's earlier buckets."""
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_bucket.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in columns],
    )
