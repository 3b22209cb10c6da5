"""Liquidity context: clustered pivot levels and their sweeps, and the tracker of fair-value gaps.

A pivot high is a bar above the ``length`` bars before it and not below the one after; it is confirmed ``length + 1`` bars
later. Pivots among the last 21 that lie within a band (a share of the average range at the confirmation) of one form a
cluster; three or more give a level at the middle of their extremes. The level is swept by the first bar within 500 bars
from the confirmation whose high passes its upper edge; a bar counts as after a sweep for 12 bars. Lows mirror this.

A gap is a bar whose low is above the high of two bars before, with the bar between closing above it too and the gap above
the threshold (the running mean of (high - low) / low). Its box is open until a bar closes below its bottom. Falls mirror it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.operators.blocks import beside, cumulated, first_passage, framed, numbered, open_extremes, tree
from barwright.operators.recurrences import averages, wilder
from barwright.staging import staged

LENGTH, MARGIN, LEAST, HELD, WITHIN, AFTER = 7, 10 / 6.9, 3, 21, 500, 12


def ranged(bars: DataFrame, span: int) -> DataFrame:
    """bars with rn and atr10, the average true range whose first value needs ten ranges that know the close before."""
    x = numbered(bars, span=span)
    before = F.lag("close").over(beside())
    x = framed(x, {"_tr": F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))}, 1)
    return averages(staged(x, "ranges"), [wilder("atr10", "_tr", 10)], span).drop("_tr")


def _within(v: Column, band: Column) -> Callable[[Column], Column]:
    return lambda y: F.abs(y - v) <= band


def swept_levels(x: DataFrame) -> DataFrame:
    """symbol, side (1: above highs), confirmed, lower, upper, swept (row numbers) of the levels of bars from ranged()."""
    w = beside()
    cols, out = {}, []
    for side, sign in (("high", 1), ("low", -1)):
        v = sign * F.col(side)
        cols[f"_p_{side}"] = (F.count(side).over(w.rowsBetween(-LENGTH, -1)) == LENGTH) & (F.col("rn") > LENGTH) & (v > F.max(v).over(w.rowsBetween(-LENGTH, -1))) & (v >= F.lead(v).over(w))
    cols["_atr"] = F.lead("atr10", LENGTH + 1).over(w)
    x = staged(x.select("symbol", "rn", "high", "low", "close", "atr10"), "levels")
    marked = staged(framed(x, cols, LENGTH, LENGTH + 1).where("_p_high or _p_low"), "pivots")
    for side, sign in (("high", 1), ("low", -1)):
        own = numbered(marked.where(f"_p_{side}").withColumnRenamed("rn", "_rn"), time="_rn", span=1 << 16)
        v, band = sign * F.col(side), F.col("_atr") / MARGIN
        held = F.collect_list(v).over(beside().rowsBetween(-HELD + 1, 0))
        own = framed(own, {"_held": held}, HELD - 1).where("_atr is not null")
        near = F.filter("_held", _within(v, band))
        mid = (F.array_max("_near") + F.array_min("_near")) / 2
        found = own.withColumn("_near", near).where(F.size("_near") >= LEAST).select("symbol", (F.col("_rn") + LENGTH + 1).alias("confirmed"), (mid - band).alias("_lo"), (mid + band).alias("_hi"))
        met = first_passage(found, tree(x, sign * F.col(side)), "confirmed", F.col("_hi"), "swept")
        edges = (("_lo", "_hi"), ("_hi", "_lo"))[sign < 0]
        out.append(met.select("symbol", F.lit(sign).alias("side"), "confirmed", *[(sign * F.col(e)).alias(n) for e, n in zip(edges, ("lower", "upper"), strict=True)], F.when(F.col("swept") < F.col("confirmed") + WITHIN, F.col("swept")).alias("swept")))
    return out[0].unionByName(out[1])


def sweeps(bars: DataFrame, span: int) -> DataFrame:
    """bars with buy_swept and sell_swept: whether a level above (below) was swept by one of the last 12 bars."""
    x = staged(ranged(bars, span), "ranged")
    events = swept_levels(x).where("swept is not null").select(F.col("symbol").alias("_k"), F.explode(F.sequence("swept", F.col("swept") + AFTER - 1)).alias("_rn"), "side")
    hit = events.groupBy("_k", "_rn").agg(F.max((F.col("side") > 0).cast("int")).alias("_buy"), F.max((F.col("side") < 0).cast("int")).alias("_sell"))
    x = x.join(hit, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("rn") == F.col("_rn")), "left")
    return x.withColumns({"buy_swept": F.coalesce("_buy", F.lit(0)) > 0, "sell_swept": F.coalesce("_sell", F.lit(0)) > 0}).drop("_k", "_rn", "_buy", "_sell")


def gaps(bars: DataFrame, span: int, threshold: float | None = None) -> DataFrame:
    """bars with rn and side (1, -1 or null), bottom and top of the gap that a bar leaves. threshold: a share of the price; None: the running mean range."""
    x = numbered(bars, span=span)
    share = (F.col("high") - F.col("low")) / F.greatest("low", F.lit(1e-9))
    x = cumulated(staged(x, "bars"), {"_sum": share})
    limit = F.lit(threshold) if threshold is not None else F.col("_sum") / (F.col("rn") + 1)
    w = beside()
    h2, l2, c1 = F.lag("high", 2).over(w), F.lag("low", 2).over(w), F.lag("close").over(w)
    x = framed(x.withColumn("_limit", limit), {"_h2": h2, "_l2": l2, "_c1": c1}, 2)
    up = (F.col("low") > F.col("_h2")) & (F.col("_c1") > F.col("_h2")) & (F.try_divide(F.col("low") - F.col("_h2"), F.col("_h2")) > F.col("_limit"))
    down = (F.col("high") < F.col("_l2")) & (F.col("_c1") < F.col("_l2")) & (F.try_divide(F.col("_l2") - F.col("high"), F.col("high")) > F.col("_limit"))
    x = x.withColumn("side", F.when(up, 1).when(down, -1))
    return x.withColumns({"bottom": F.when(F.col("side") > 0, F.col("_h2")).when(F.col("side") < 0, F.col("high")), "top": F.when(F.col("side") > 0, F.col("low")).when(F.col("side") < 0, F.col("_l2"))}).drop("_h2", "_l2", "_c1", "_limit", "_sum")


def boxes(x: DataFrame) -> DataFrame:
    """symbol, side, bottom, top, created and closed (row numbers; null: still open) of the gaps of bars from gaps()."""
    made = x.where("side is not null").select("symbol", "side", "bottom", "top", F.col("rn").alias("created"))
    up = first_passage(made.where("side > 0"), tree(x, -F.col("close")), "created", -F.col("bottom"), "closed")
    down = first_passage(made.where("side < 0"), tree(x, F.col("close")), "created", F.col("top"), "closed")
    return up.unionByName(down)


def open_boxes(bars: DataFrame, span: int, threshold: float | None = None) -> DataFrame:
    """bars with bulls and bears, the numbers of boxes open after each bar, support (the highest top of an open bull box) and resistance (the lowest bottom of a bear box)."""
    x = staged(gaps(bars, span, threshold), "gaps")
    found = staged(boxes(x), "boxes")
    turns = [found.select(F.col("symbol").alias("_k"), "side", F.col(at).alias("_rn"), F.lit(n).alias("_n")).where("_rn is not null") for at, n in (("created", 1), ("closed", -1))]
    changes = turns[0].union(turns[1]).groupBy("_k", "_rn").agg(*[F.sum(F.when(F.col("side") == s, F.col("_n")).otherwise(0)).alias(c) for s, c in ((1, "_up"), (-1, "_down"))])
    y = x.join(changes, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("rn") == F.col("_rn")), "left").drop("_k", "_rn")
    y = cumulated(y, {"bulls": F.coalesce("_up", F.lit(0)), "bears": F.coalesce("_down", F.lit(0))})
    last = x.agg(F.max("rn")).first()[0]
    until = found.withColumn("_last", F.coalesce(F.col("closed") - 1, F.lit(last)))
    y = open_extremes(y, until.where("side > 0"), F.col("top"), "created", "_last", "support")
    y = open_extremes(y, until.where("side < 0"), -F.col("bottom"), "created", "_last", "resistance")
    return y.withColumn("resistance", -F.col("resistance")).drop("_up", "_down")
