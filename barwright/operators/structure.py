"""Market structure from pivots: breaks that go on with a trend or turn it, and order blocks; all in frames and joins.

A pivot is a bar whose high (low) is the strict extreme of ``length`` bars on both sides; it is known ``length`` bars
later. A close that crosses the last known pivot breaks it. The trend is the side of the last break (down before any):
a break against it turns it (event 2 or -2), one with it goes on (1 or -1). A break up makes the bar with the least low
since the broken pivot an order block (break down: the greatest high), until a close passes its far edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the join of breaks with the bars since their pivot.
BLOCK = 256


def pivots(bars: DataFrame, length: int = 10) -> DataFrame:
    """bars with rn (from 1), pivot_high, pivot_high_rn, pivot_low, pivot_low_rn: the last known ones at each bar."""
    w = Window.partitionBy("symbol").orderBy("time")
    before, after = w.rowsBetween(-length, -1), w.rowsBetween(1, length)
    full = (F.count("high").over(before) == length) & (F.count("high").over(after) == length)
    bars = bars.withColumns({
        "rn": F.row_number().over(w),
        "_ph": full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)),
        "_pl": full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)),
    })
    bars = bars.withColumns({"_h": F.when(F.lag("_ph", length).over(w), F.lag("high", length).over(w)), "_l": F.when(F.lag("_pl", length).over(w), F.lag("low", length).over(w)), "_hr": F.when(F.lag("_ph", length).over(w), F.col("rn") - length), "_lr": F.when(F.lag("_pl", length).over(w), F.col("rn") - length)})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    last = {"pivot_high": "_h", "pivot_low": "_l", "pivot_high_rn": "_hr", "pivot_low_rn": "_lr"}
    return bars.withColumns({k: F.last(v, ignorenulls=True).over(run) for k, v in last.items()}).drop("_ph", "_pl", "_h", "_l", "_hr", "_lr")


def structure(bars: DataFrame, length: int = 10) -> DataFrame:
    """bars with pivots, trend (1, -1), event (2, 1, -1, -2, 0) and the order blocks bull_low, bull_high, bear_low, bear_high."""
    w = Window.partitionBy("symbol").orderBy("time")
    run, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = pivots(bars, length)
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    x = x.withColumn("_before", before)
    up = F.coalesce((F.col("_before") <= F.col("pivot_high")) & (F.col("close") > F.col("pivot_high")), F.lit(False))
    down = F.coalesce((F.col("_before") >= F.col("pivot_low")) & (F.col("close") < F.col("pivot_low")), F.lit(False))
    x = x.withColumn("_side", F.when(up, 1).when(down, -1))
    trend_before = F.coalesce(F.last("_side", ignorenulls=True).over(earlier), F.lit(-1))
    x = x.withColumns({"trend": F.coalesce(F.last("_side", ignorenulls=True).over(run), F.lit(-1)), "_was": trend_before})
    x = x.withColumn("event", F.when(F.col("_side").isNull(), 0).when(F.col("_side") == F.col("_was"), F.col("_side")).otherwise(2 * F.col("_side")))
    x = x.withColumns({"_ups": F.count(F.when(F.col("_side") == 1, 1)).over(run), "_downs": F.count(F.when(F.col("_side") == -1, 1)).over(run)})
    for side, group, origin in ((1, "_ups", "bull"), (-1, "_downs", "bear")):
        x = _with_block(x, side, group, origin)
    return x.drop("_before", "_side", "_was", "_ups", "_downs")


def _with_block(x: DataFrame, side: int, group: str, name: str) -> DataFrame:
    """The order block of the last break to a side, while no close since has passed its far edge."""
    pivot = F.col("pivot_high_rn") if side > 0 else F.col("pivot_low_rn")
    breaks = x.where(F.col("_side") == side).select(F.col("symbol").alias("_s"), F.col(group).alias("_g"), F.col("rn").alias("_to"), pivot.alias("_from"))
    blocks = breaks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_to") / BLOCK))))
    rows = x.select("symbol", "rn", "high", "low", F.floor(F.col("rn") / BLOCK).alias("_rb"))
    j = blocks.join(rows, (F.col("_s") == F.col("symbol")) & (F.col("_b") == F.col("_rb")) & F.col("rn").between(F.col("_from"), F.col("_to")))
    best = F.min(F.struct((F.col("low") if side > 0 else -F.col("high")).alias("edge"), F.col("rn"), F.col("high").alias("top"), F.col("low").alias("bottom"))).alias("_o")
    found = j.groupBy(F.col("_s").alias("symbol"), F.col("_g").alias(group)).agg(best).select("symbol", group, F.col("_o.bottom").alias("_lo"), F.col("_o.top").alias("_hi"))
    x = x.join(found, ["symbol", group], "left")
    w = Window.partitionBy("symbol", group).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    alive = (F.min("close").over(w) >= F.col("_lo")) if side > 0 else (F.max("close").over(w) <= F.col("_hi"))
    return x.withColumns({f"{name}_low": F.when(alive, F.col("_lo")), f"{name}_high": F.when(alive, F.col("_hi"))}).drop("_lo", "_hi")
