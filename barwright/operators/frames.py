"""Row frames over a series: values of earlier rows only, null until a frame is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str = "symbol", time: str = "time") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def shift(c: str, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w)


def rolled(f: Column, c: str, n: int, w: WindowSpec, current: bool = False) -> Column:
    """f over the n rows before this one (or ending with it), null unless there are n values."""
    frame = w.rowsBetween(-n + 1, 0) if current else w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, f.over(frame))


def candle_parts(bars: DataFrame) -> DataFrame:
    """body, range, upper and lower wick, and the true range of each bar."""
    w = series()
    before = F.lag("close").over(w)
    top, low = F.greatest("open", "close"), F.least("open", "close")
    return bars.withColumns({
        "body": F.abs(F.col("close") - F.col("open")), "range": F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)), "upper_wick": F.col("high") - top, "lower_wick": low - F.col("low"),
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
    })


def rolling_features(bars: DataFrame) -> DataFrame:
    """Channel, mean, deviation, Bollinger bands, efficiency ratio (0 on a flat path) and the 48 earlier bars' volume-weighted close."""
    w = series()
    bars = bars.withColumns({"_step": F.abs(F.col("close") - F.lag("close").over(w)), "_pv": F.col("close") * F.col("tick_volume")})
    mean20, sd20 = rolled(F.avg("close"), "close", 20, w, True), rolled(F.stddev_pop("close"), "close", 20, w, True)
    moved = F.abs(F.col("close") - F.lag("close", 20).over(w))
    path = rolled(F.sum("_step"), "_step", 20, w, True)
    return bars.withColumns({
        "hh20": rolled(F.max("high"), "high", 20, w), "ll20": rolled(F.min("low"), "low", 20, w), "mean40": rolled(F.avg("close"), "close", 40, w), "sd40": rolled(F.stddev_pop("close"), "close", 40, w),
        "bb_mid": mean20, "bb_up": mean20 + 2 * sd20, "bb_low": mean20 - 2 * sd20, "er20": F.when(path.isNotNull(), F.coalesce(F.try_divide(moved, path), F.lit(0.0))),
        "vwap48": F.try_divide(rolled(F.sum("_pv"), "_pv", 48, w), rolled(F.sum("tick_volume"), "tick_volume", 48, w)),
    }).drop("_step", "_pv")


def share_below(bars: DataFrame, c: str, n: int) -> DataFrame:
    """The share of the n earlier values that are strictly less than this one."""
    w = series().rowsBetween(-n, -1)
    held = F.collect_list(c).over(w)
    return bars.withColumn(f"{c}_share", F.when(F.size(held) == n, F.size(F.filter(held, lambda x: x < F.col(c))) / F.lit(float(n))))
