"""Ratios of trades, periods and folds, prices of execution, and levels and filters of bars that reports and screens use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.functions.numeric import safe_div
from barwright.operators import trades as tr
from barwright.operators.frames import rolled, series

#: Minutes of trading in a year, by which returns are annualized (fixed value).
YEAR_MINUTES = 252 * 6.5 * 60


def ratios(trades: DataFrame, start: float) -> DataFrame:
    """Each strategy's minutes held (mean, median), return in per cent, annualized return over the largest fall (Calmar), and gains over losses (Omega; null without a loss). Only trades that have ended."""
    t = trades.where("exit_time IS NOT NULL").withColumn("_m", (F.col("exit_time") - F.col("entry_time")) / 60.0)
    pl = F.col("net_pl")
    s = t.groupBy("strategy").agg(F.avg("_m").alias("avg_minutes"), F.percentile("_m", F.lit(0.5)).alias("median_minutes"), (F.sum(pl) / start * 100).alias("return_pct"), F.avg(pl).alias("_e"), F.sum(F.greatest(pl, F.lit(0.0))).alias("_g"), F.sum(F.greatest(-pl, F.lit(0.0))).alias("_l"))
    s = s.join(tr.drawdown(trades, start).select("strategy", F.round("drawdown_pct", 6).alias("_d")), "strategy")
    yearly = F.coalesce(F.try_divide(F.col("_e") * YEAR_MINUTES, F.col("avg_minutes")) / start * 100, F.col("return_pct"))
    return s.select("strategy", "avg_minutes", "median_minutes", "return_pct", F.round(safe_div(yearly, F.col("_d")), 3).alias("calmar"), F.when(F.col("_l") > 0, F.try_divide("_g", "_l")).when(F.col("_g") == 0, 0.0).alias("omega"))


def periods(trades: DataFrame, seconds: int) -> DataFrame:
    """Buckets of each strategy's trades by fixed periods of their exits."""
    t = trades.where("exit_time IS NOT NULL")
    return tr.buckets(t, "strategy", F.floor(F.col("exit_time") / seconds).cast("long").alias("period"))


def folds(trades: DataFrame, begin: int, train: int, test: int) -> DataFrame:
    """Buckets of a walk forward: fold k trains on [begin + k * test, + train) and tests on the ``test`` seconds after it. A trade goes by its entry to all folds that hold it, found by arithmetic and not by a join."""
    since = F.col("entry_time") - begin
    upto = F.floor(since / test).cast("int")
    first = F.greatest(F.lit(0), F.floor((since - train) / test).cast("int") + 1)
    held = F.floor((since - train) / test).cast("int")
    pair = lambda k, part: F.struct(k.alias("fold"), F.lit(part).alias("part"))
    trained = F.when(upto >= first, F.transform(F.sequence(first, upto), lambda k: pair(k, "train"))).otherwise(F.expr("array()").cast("array<struct<fold:int,part:string>>"))
    tested = F.when(held >= 0, F.array(pair(held, "test"))).otherwise(F.expr("array()").cast("array<struct<fold:int,part:string>>"))
    x = trades.where(since >= 0).withColumn("_f", F.explode(F.concat(trained, tested)))
    return tr.buckets(x, F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part"))


def execution_prices(bars: DataFrame, points: str, point: float = 0.001, fixed: float = 20.0, multiplier: float = 1.0, slip: float = 5.0, commission: float = 7.0, lots: float = 0.01, contract: float = 100.0, leverage: float = 500.0) -> DataFrame:
    """bars with the spread in price (a bar's own points, the fixed ones where it has none), ask, bid, slip, commission and margin of an order at the close."""
    pts = F.when(F.coalesce(F.col(points), F.lit(0)) != 0, F.col(points).cast("double")).otherwise(fixed)
    spread = pts * point * multiplier
    return bars.withColumns({"spread_price": spread, "ask": F.col("close") + spread, "bid": F.col("close"), "slip": F.lit(slip * point), "commission": F.lit(commission * lots), "margin": contract * F.col("close") * lots / leverage})


def stop_levels(bars: DataFrame, side: str, target: float = 3.0, strict_shorts: bool = False) -> DataFrame:
    """bars (close, atr14, ist_hour) with stop and target by the average range, the stop's multiple by the session; null without a range. strict_shorts: shorts take 1 and 2 ranges."""
    short = F.lit(strict_shorts) & (F.col(side) < 0)
    range_ = F.when(F.col("atr14") > 0, F.col("atr14"))
    s = F.when(short, 1.0).otherwise(cal.stop_multiplier(F.col("ist_hour"))) * range_
    t = F.when(short, 2.0).otherwise(target) * range_
    return bars.withColumns({"stop": F.bround(F.col("close") - F.col(side) * s, 3), "target": F.bround(F.col("close") + F.col(side) * t, 3)})


def random_signals(bars: DataFrame, share: float, seed: str = "random") -> DataFrame:
    """A signal on about that share of bars, long or short alike, by hashes of symbol and time."""
    unit = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-{tag}"), F.col("symbol"), F.col("time").cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
    return bars.where(unit("fires") < share).select("symbol", "time", F.when(unit("side") < 0.5, 1).otherwise(-1).alias("signal"))


def bias_agreement(bars: DataFrame, fast: str = "ema20", slow: str = "ema200", n: int = 60) -> DataFrame:
    """In each symbol's last n bars: how many have both averages, and on how many of these the close lies on the same side of both."""
    last = bars.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).where(F.col("_rn") <= n)
    both = F.col(fast).isNotNull() & F.col(slow).isNotNull()
    return last.groupBy("symbol").agg(F.count_if(both).alias("bars"), F.count_if(both & ((F.col("close") > F.col(fast)) == (F.col("close") > F.col(slow)))).alias("agree"))


def gap_signals(bars: DataFrame, share: float, ranges: float) -> DataFrame:
    """Three-bar gaps that pass each filter: by a share of the price, by a number of average ranges, and with the middle bar's close beyond the first bar. symbol, time, by_share, by_range, confirmed: -1, 0 or 1; bars without any are left out."""
    w = series()
    x = bars.withColumns({"_h": F.lag("high", 2).over(w), "_l": F.lag("low", 2).over(w), "_c": F.lag("close", 1).over(w)})
    up, down = F.col("low") - F.col("_h"), F.col("_l") - F.col("high")
    side = lambda most: F.when((down > 0) & (down >= most), -1).when((up > 0) & (up >= most), 1).otherwise(0)
    confirmed = F.when((down > 0) & (F.col("_c") < F.col("_l")), -1).when((up > 0) & (F.col("_c") > F.col("_h")), 1).otherwise(0)
    x = x.withColumns({"by_share": side(share * F.col("close")), "by_range": side(ranges * F.col("atr14")), "confirmed": confirmed})
    return x.where("by_share <> 0 OR by_range <> 0 OR confirmed <> 0").select("symbol", "time", "by_share", "by_range", "confirmed")


def session_widths(bars: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Width of each occurrence of a session, and the share of its (at most n) predecessors that are narrower, null below ``least``. bars have occurrence; one as wide as its predecessor isn't a new one."""
    w = Window.partitionBy("symbol").orderBy("occurrence")
    p = bars.where("occurrence IS NOT NULL").groupBy("symbol", "occurrence").agg((F.max("high") - F.min("low")).alias("width"))
    p = p.withColumn("_before", F.lag("width").over(w)).where("_before IS NULL OR width <> _before")
    held = F.collect_list("width").over(w.rowsBetween(-n, -1))
    return p.select("symbol", "occurrence", "width", F.when(F.size(held) >= least, F.size(F.filter(held, lambda x: x < F.col("width"))) / F.size(held)).alias("narrower"))


def slot_ratio(bars: DataFrame, c: str = "atr14", slot: int = 3600, least: int = 3) -> DataFrame:
    """Mean of c in the bar's slot of the IST day up to it, over the mean of all bars up to it; 1 below ``least`` values or where the mean is 0."""
    before = lambda *keys: Window.partitionBy("symbol", *keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    x = bars.withColumn("_slot", F.floor(F.pmod(F.col("time") + cal.IST, F.lit(cal.DAY)) / slot))
    own = F.when(F.count(c).over(before("_slot")) >= least, F.avg(c).over(before("_slot")))
    return x.withColumn("slot_ratio", F.coalesce(F.try_divide(own, F.avg(c).over(before())), F.lit(1.0))).drop("_slot")


def day_so_far(bars: DataFrame) -> DataFrame:
    """bars (with ist_day) with the high and low of their day before them; null on its first bar."""
    w = Window.partitionBy("symbol", "ist_day").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumns({"day_high": F.max("high").over(w), "day_low": F.min("low").over(w)})


def median_range(bars: DataFrame, n: int = 100) -> DataFrame:
    """bars with the median of atr14 over the n bars up to each; null until there are as many."""
    return bars.withColumn("median_range", rolled(F.percentile("atr14", F.lit(0.5)), "atr14", n, series(), True))
