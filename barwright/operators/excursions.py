"""What happened between a trade's entry and its exit, and views of the past that bars allow at a time.

Trades meet the bars of their life through a tree of blocks: two nodes a level, whatever the length of the trade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.numeric import safe_div
from barwright.operators.bars import as_of
from barwright.operators.blocks import beside, extremes, framed, numbered, placed, tree
from barwright.staging import staged


def excursions(trades: DataFrame, bars: DataFrame, span: int, market: str = "market") -> DataFrame:
    """trades with bars_held, mfe_r, mae_r and minutes_to_mfe.

    trades: market, entry_time, exit_time, is_buy, entry_price, risk. bars: market, time, high, low; those that begin from
    the entry on and before the exit count. Excursions begin at the entry price: mfe_r is 0 or more, mae_r 0 or less, in
    units of the risk (a risk of 0 gives 0). minutes_to_mfe counts the minute of the first best price from 1; 0 where
    price never was better than the entry. A trade without an exit, or without bars, has 0 everywhere.
    """
    b = staged(numbered(bars, market, span=span), "bars")
    x = placed(placed(trades, b, "entry_time", "_first", key=market, span=span), b, "exit_time", "_end", key=market, span=span).withColumn("_last", F.col("_end") - 1)
    x = extremes(staged(x, "placed"), tree(b, F.col("high"), market), "_first", "_last", "_high")
    x = extremes(staged(x, "highs"), tree(b, -F.col("low"), market), "_first", "_last", "_low")
    times = b.select(F.col(market).alias("_m"), F.col("rn").alias("_rn"), F.col("time").alias("_best"))
    best = F.when(F.col("is_buy"), F.col("_high") - F.col("entry_price")).otherwise(F.col("_low") + F.col("entry_price"))
    worst = F.when(F.col("is_buy"), F.col("_low") + F.col("entry_price")).otherwise(F.col("_high") - F.col("entry_price"))
    x = x.withColumns({"_gain": F.greatest(best, F.lit(0.0)), "_loss": F.greatest(worst, F.lit(0.0)), "_at": F.when(F.col("is_buy"), F.col("_high_rn")).otherwise(F.col("_low_rn"))})
    x = x.join(times, F.col(market).eqNullSafe(F.col("_m")) & (F.col("_at") == F.col("_rn")), "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        *trades.columns, F.coalesce(F.greatest(F.col("_end") - F.col("_first"), F.lit(0)), F.lit(0)).alias("bars_held"), none(safe_div(F.col("_gain"), F.col("risk"))).alias("mfe_r"), none(-safe_div(F.col("_loss"), F.col("risk"))).alias("mae_r"),
        F.when(F.col("_gain") > 0, F.floor((F.col("_best") - F.col("entry_time")) / 60) + 1).otherwise(0).alias("minutes_to_mfe"),
    )


def excursion_summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Average excursions, the share of the favourable one that exits kept, and times, of excursions() with r."""
    open_for = (F.col("exit_time") - F.col("entry_time")) / 60.0
    x = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("mae_r").alias("avg_mae_r"), F.avg("mfe_r").alias("avg_mfe_r"), F.avg("r").alias("_r"), F.avg(open_for).alias("avg_minutes_open"), F.percentile(open_for, F.lit(0.5)).alias("median_minutes_open"), F.avg("minutes_to_mfe").alias("avg_minutes_to_mfe"),
    )
    return x.withColumn("mfe_capture", safe_div(F.col("_r"), F.col("avg_mfe_r"))).drop("_r")


def histories(asks: DataFrame, bars: DataFrame, count: int, step: int, at: str, span: int, fields: tuple[str, ...] = ("time", "open", "high", "low", "close", "tick_volume")) -> DataFrame:
    """asks with view: count bars as one sees them at a time, the last of them forming; null where there are fewer.

    A bar that begins at t is seen as closed from t + step on. The forming bar begins at the time asked for and has the last
    close as its four prices, and no volume: nothing of a bar that hasn't closed is in a view.
    """
    own = F.collect_list(F.struct(*fields)).over(beside().rowsBetween(-(count - 2), 0))
    seen = framed(numbered(bars, span=span), {"_closed": own}, count - 2).where(F.size("_closed") == count - 1).withColumn("_shut", F.col("time") + step)
    got = as_of(asks, seen.select("symbol", "_shut", "_closed"), ["_closed"], span, at, "_shut")
    last = F.element_at("_closed", -1)
    forming = F.struct(*[F.col(at).cast("long").alias(f) if f == "time" else F.lit(0).cast("long").alias(f) if f == "tick_volume" else last["close"].alias(f) for f in fields])
    return got.withColumn("view", F.when(F.col("_closed").isNotNull(), F.concat("_closed", F.array(forming)))).drop("_closed")


def nearest_prior(left: DataFrame, right: DataFrame, values: list[str], lag: int, bucket: int, left_time: str, right_time: str, key: str) -> DataFrame:
    """left with the values of the last right row of its key at or before its time and less than lag earlier, else null."""
    got = as_of(left, right.withColumn("_when", F.col(right_time).cast("long")), [*values, "_when"], bucket, left_time, right_time, key)
    near = F.col(left_time).cast("long") - F.col("_when") < lag
    return got.withColumns({v: F.when(near, F.col(v)) for v in values}).drop("_when")


def closed_reasons(trades: DataFrame, closes: DataFrame) -> DataFrame:
    """Trades, net result and win rate by strategy and recorded exit reason. closes: trade_id, reason, one row a trade; a trade without one is open, an empty reason is unknown."""
    w = Window.partitionBy("strategy")
    x = trades.join(closes.select("trade_id", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")).alias("reason")), "trade_id", "left").withColumn("reason", F.coalesce("reason", F.lit("open")))
    g = x.groupBy("strategy", "reason").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pl").alias("net_pl"), (100.0 * F.count_if(F.col("net_pl") > 0) / F.count(F.lit(1))).alias("win_rate"))
    return g.withColumn("share", F.col("trades") / F.sum("trades").over(w))
