"""Arithmetic with the conventions of the analytics: missing is null, division by zero has a default, halves go to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(F.try_divide(a, b))


def round_level(price: Column, step: float) -> Column:
    """The nearest multiple of step, halves to the even one."""
    return F.bround(price / step) * step


def strict_greatest(*cols: Column) -> Column:
    """The greatest, null if any is null."""
    return F.when(~sum((c.isNull().cast("int") for c in cols), F.lit(0)).cast("boolean"), F.greatest(*cols))


def signal(long: Column, short: Column) -> Column:
    """-1, 0 or 1; a null condition is false, and short goes before long."""
    return F.when(F.coalesce(short, F.lit(False)), -1).when(F.coalesce(long, F.lit(False)), 1).otherwise(0)


def profit_factor(gain: Column, loss: Column) -> Column:
    """gain over loss; infinite (null here) without losses, 0 without both."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(None).cast("double")).otherwise(0.0)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of the rows that have both; null where either is constant (corr() raises there)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
