"""Rates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """Wilson score interval in percent, rounded to 4 places; zeros when n is not positive."""
    n_ = n.cast("double")
    p = F.try_divide(successes.cast("double"), n_)
    denom = 1 + z * z / n_
    center = (p + z * z / (2 * n_)) / denom
    margin = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / denom
    ok = n > 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(ok, F.round(p * 100, 4)).otherwise(zero).alias("pct"),
        F.when(ok, F.round(F.greatest(zero, center - margin) * 100, 4)).otherwise(zero).alias("ci_low_pct"),
        F.when(ok, F.round(F.least(F.lit(1.0), center + margin) * 100, 4)).otherwise(zero).alias("ci_high_pct"),
    )


def whole_percent(part: Column, total: Column) -> Column:
    """Truncating integer percent, 0 when the total is 0."""
    share = F.call_function("div", (part * 100).cast("bigint"), F.nullif(total, F.lit(0)).cast("bigint"))
    return F.coalesce(share, F.lit(0).cast("bigint"))


def percent(part: Column, total: Column) -> Column:
    """Float percent, 0 when the total is 0."""
    return F.coalesce(F.try_divide(100.0 * part, total.cast("double")), F.lit(0.0))


def ratio(part: Column, total: Column, places: int = 6) -> Column:
    """Rounded ratio, NULL on a zero denominator."""
    return F.round(F.try_divide(part.cast("double"), total.cast("double")), places)
