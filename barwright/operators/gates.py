"""Gates that a signal passes: bias of the day, spread, volatility, drawdown of the day, caps, and the first reason against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators.bars import as_of
from barwright.operators.recurrences import averages, ema

DAY = 86_400


def daily_bias(bars: DataFrame, days: DataFrame, p: int) -> DataFrame:
    """bars with day_time, day_close and bias (side of the p-day average) of the last day that had closed at the bar's time."""
    d = averages(days.select("symbol", "time", "close"), [ema("_mean", "close", p)], 365 * DAY)
    side = F.when(F.col("close") > F.col("_mean"), 1).when(F.col("close") < F.col("_mean"), -1).when(F.col("_mean").isNotNull(), 0)
    closed = d.select("symbol", (F.col("time") + DAY).alias("_closed"), F.col("time").alias("day_time"), F.col("close").alias("day_close"), side.alias("bias"))
    return as_of(bars, closed, ["day_time", "day_close", "bias"], 7 * DAY, right_time="_closed")


def direction(side: Column, bias: Column) -> Column:
    """Whether a side goes with a bias; no bias, or an even one, stops nothing."""
    return F.coalesce(bias, F.lit(0)).isin(0) | (side == bias)


def volatility(x: Column, low: float, high: float) -> Column:
    """Null passes."""
    return x.isNull() | x.between(low, high)


def spread(points: Column, most: int = 350) -> Column:
    return points <= most


def shrank(atr: str, w, share: float = 0.3, bars: int = 3) -> Column:
    """Consolidation: the average range fell by more than a share against some bars ago."""
    before = F.lag(atr, bars).over(w)
    return F.coalesce((before > 0) & (F.col(atr) < (1 - share) * before), F.lit(False))


def may_add(side: Column, price: Column, entry: Column, atr: Column, least: float = 0.5) -> Column:
    """Pyramiding: price has gone at least so many ranges a position's way."""
    return F.coalesce((atr > 0) & (side * (price - entry) >= least * atr), F.lit(False))


def closed_market(code: Column, text: Column) -> Column:
    """A broker's answer that says that the market is closed (fixed values)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(code.isin(10018), F.lit(False)) | low.contains("market closed") | low.contains("market is closed")


def first_reason(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate that doesn't pass, in order; null if all do. A null answer stops."""
    return F.coalesce(*[F.when(~F.coalesce(passes, F.lit(False)), name) for name, passes in gates], F.lit(None).cast("string"))


def daily_breaker(trades: DataFrame, most: float) -> DataFrame:
    """trades with day_loss, what the trades that had ended before the entry on its IST day made, and stopped: whether that is a loss of most or more."""
    day = cal.ist_day(F.col("entry_time")).cast("long")
    ended = trades.where("exit_time IS NOT NULL").select(F.col("strategy").alias("_s"), cal.ist_day(F.col("exit_time")).cast("long").alias("_d"), F.col("exit_time").alias("_t"), F.lit(0).alias("_k"), F.col("net_pl").alias("_pl"))
    asked = trades.withColumns({"_s": F.col("strategy"), "_d": day, "_t": F.col("entry_time"), "_k": F.lit(1)})
    both = asked.unionByName(ended, allowMissingColumns=True)
    w = Window.partitionBy("_s", "_d").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("day_loss", F.coalesce(F.sum("_pl").over(w), F.lit(0.0))).where("_k = 1")
    return out.withColumn("stopped", F.col("day_loss") <= -most).select(*trades.columns, "day_loss", "stopped")
