"""Number helpers: safe casts, guarded rates, exact decimal rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**61: scales the fraction of a double to a whole number.
_SCALE = 1 << 61


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def coerce(value: Column | str, to: str = "double") -> Column:
    """Cast that turns bad text and NaN into NULL."""
    number = as_column(value).try_cast(to)
    if to in ("double", "float"):
        return F.when(~F.isnan(number), number)
    return number


def rate(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL unless the denominator is above 0."""
    return F.when(denominator > 0, numerator / denominator)


def share(condition: Column, among: Column | None = None) -> Column:
    """Aggregate: share of rows where ``condition`` holds, out of those where ``among`` holds."""
    hit = F.when(condition, 1.0).otherwise(0.0)
    return F.avg(hit if among is None else F.when(among, hit))


def round_exact(value: Column | str, digits: int) -> Column:
    """Round a double half to even on its binary value, as IEEE-aware runtimes do.

    Spark's ``round``/``bround`` work on the shortest decimal text, so 2.675 becomes
    2.68 there although the double lies below the tie; here it becomes 2.67.
    """
    x = as_column(value).cast("double")
    whole = F.floor(x)
    fraction = ((x - whole) * F.lit(float(_SCALE))).cast("bigint").cast("decimal(20,0)")
    scaled = (fraction * F.lit(10**digits).cast("decimal(8,0)")).cast("decimal(38,0)")
    unit = F.lit(_SCALE).cast("decimal(20,0)")
    steps = F.floor(scaled / unit).cast("decimal(38,0)")
    rest = ((scaled - steps * unit) * 2).cast("decimal(38,0)")
    up = (rest > unit) | ((rest == unit) & (steps % 2 == 1))
    final = steps + F.when(up, 1).otherwise(0)
    return (whole * F.lit(10**digits).cast("decimal(8,0)") + final).cast("double") / F.lit(float(10**digits))
