"""Barrier races and screens of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.numeric import correlation
from barwright.operators.chunkmaps import spaced


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("time")))


def race(bars: DataFrame, entries: DataFrame, target: Column, stop: Column, most: int, spread: str | None = None) -> DataFrame:
    """Entries (symbol, rn, side, entry, and what target and stop name) with what they touch first in the next ``most`` bars.

    A bounded range join on blocks of ``most`` bar numbers: each entry meets its own block and the next. The stop wins
    a bar that touches both. spread: a column of bars by which a short's prices (it ends on the ask) are higher.
    Result: outcome (1, -1, 0 for neither), exit_rn, both (whether a bar touched both before or at the end), last_close.
    """
    e = entries.withColumns({"_target": target, "_stop": stop, "_entry_id": F.struct("symbol", "rn", "side")})
    e = e.withColumn("_block", F.explode(F.array(F.floor((F.col("rn") + 1) / most), F.floor((F.col("rn") + most) / most)))).dropDuplicates(["_entry_id", "_block"])
    b = bars.select(F.col("symbol").alias("_s"), F.col("rn").alias("_rn"), "high", "low", "close", (F.col(spread) if spread else F.lit(0.0)).alias("_sp"), F.floor(F.col("rn") / most).alias("_b"))
    j = e.drop("high", "low", "close").join(b, (F.col("symbol") == F.col("_s")) & (F.col("_block") == F.col("_b")) & (F.col("_rn") > F.col("rn")) & (F.col("_rn") <= F.col("rn") + most))
    long = F.col("side") > 0
    stopped = F.when(long, F.col("low") <= F.col("_stop")).otherwise(F.col("high") + F.col("_sp") >= F.col("_stop"))
    won = F.when(long, F.col("high") >= F.col("_target")).otherwise(F.col("low") + F.col("_sp") <= F.col("_target"))
    r = j.groupBy("symbol", "rn", "side").agg(F.min(F.when(stopped, F.col("_rn"))).alias("s"), F.min(F.when(won, F.col("_rn"))).alias("t"), F.min(F.when(stopped & won, F.col("_rn"))).alias("w"), F.max("_rn").alias("last"), F.max_by(F.col("close") + F.when(F.col("side") > 0, 0.0).otherwise(F.col("_sp")), "_rn").alias("last_close"))
    outcome = F.when(F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t"))), -1).when(F.col("t").isNotNull(), 1).otherwise(0)
    return r.withColumns({"outcome": outcome, "exit_rn": F.when(outcome == -1, F.col("s")).when(outcome == 1, F.col("t")).otherwise(F.col("last"))}).withColumn("both", F.coalesce(F.col("w") <= F.col("exit_rn"), F.lit(False))).drop("s", "t", "w", "last")


def entries_of(featured: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals entered at the next bar's open: symbol, rn, time, side, entry, atr14."""
    w = Window.partitionBy("symbol").orderBy("time")
    f = featured.withColumn("entry", F.lead("open").over(w)).select("symbol", "time", "rn", "entry", "atr14")
    return f.join(signals.select("symbol", "time", F.col("signal").alias("side")), ["symbol", "time"]).where("entry IS NOT NULL AND atr14 > 0")


def one_at_a_time(raced: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Greedy choice: an entry counts if it comes after the bar in which the last chosen one ended. A state machine over entries, not bars."""
    return spaced(raced, list(keys), "rn", "exit_rn", 1)


def simulated(bars: DataFrame, signals: DataFrame, target: float, stop: float, most: int, keys: tuple[str, ...]) -> DataFrame:
    """Trades of signals (keys, symbol, rn, side), one at a time for each of keys and symbol: rn, side, exit_rn, outcome, both, r.

    bars: symbol, rn, prices, spread, atr14. Entry is the next bar's open (a long's plus its spread); the stop wins a bar
    that touches both; after ``most`` bars the close ends it. r is the result in units of the first stop's distance.
    An entry is raced once, whichever signals ask for it. Signals without a range, or in a series' last two bars, are none.
    """
    w = Window.partitionBy("symbol").orderBy("rn")
    ahead = bars.select("symbol", "rn", "atr14", F.lead("open").over(w).alias("_open"), F.lead("spread").over(w).alias("_spread"), F.lead("rn", 2).over(w).alias("_third"))
    asked = signals.select("symbol", "rn", "side").distinct().join(ahead.where("atr14 > 0 AND _third IS NOT NULL"), ["symbol", "rn"])
    e = asked.withColumn("entry", F.col("_open") + F.when(F.col("side") > 0, F.col("_spread")).otherwise(0.0)).select("symbol", "rn", "side", "entry", "atr14")
    x = race(bars, e, F.col("entry") + F.col("side") * target * F.col("atr14"), F.col("entry") - F.col("side") * stop * F.col("atr14"), most, "spread")
    moved = F.when(F.col("outcome") == 1, F.lit(float(target))).when(F.col("outcome") == -1, F.lit(-float(stop))).otherwise(F.col("side") * (F.col("last_close") - F.col("entry")) / F.col("atr14"))
    x = x.join(e, ["symbol", "rn", "side"]).withColumn("r", moved / stop).select("symbol", "rn", "side", "exit_rn", "outcome", "both", "r")
    return one_at_a_time(signals.select(*keys, "symbol", "rn", "side").join(x, ["symbol", "rn", "side"]), (*keys, "symbol"))


def simulated_each(bars: DataFrame, signals: DataFrame, keys: tuple[str, ...], longest: int) -> DataFrame:
    """Trades as simulated(), of signals that bring their own target, stop (in ranges) and hold (in bars, at most longest).

    An entry is raced once for each exit that is asked of it. Its bars come from its block of ``longest`` bar numbers and
    the next, whatever its own hold.
    """
    w = Window.partitionBy("symbol").orderBy("rn")
    ahead = bars.select("symbol", "rn", "atr14", F.lead("open").over(w).alias("_open"), F.lead("spread").over(w).alias("_spread"), F.lead("rn", 2).over(w).alias("_third"))
    own = ["symbol", "rn", "side", "target", "stop", "hold"]
    e = signals.select(*own).distinct().join(ahead.where("atr14 > 0 AND _third IS NOT NULL"), ["symbol", "rn"])
    long = F.col("side") > 0
    e = e.withColumn("entry", F.col("_open") + F.when(long, F.col("_spread")).otherwise(0.0)).drop("_open", "_spread", "_third")
    e = e.withColumns({"_target": F.col("entry") + F.col("side") * F.col("target") * F.col("atr14"), "_stop": F.col("entry") - F.col("side") * F.col("stop") * F.col("atr14")})
    blocks = F.array_distinct(F.array(F.floor((F.col("rn") + 1) / longest), F.floor((F.col("rn") + F.col("hold")) / longest)))
    b = bars.select(F.col("symbol").alias("_s"), F.col("rn").alias("_rn"), "high", "low", "close", F.col("spread").alias("_sp"), F.floor(F.col("rn") / longest).alias("_b"))
    j = e.withColumn("_block", F.explode(blocks)).join(b, (F.col("symbol") == F.col("_s")) & (F.col("_block") == F.col("_b")) & (F.col("_rn") > F.col("rn")) & (F.col("_rn") <= F.col("rn") + F.col("hold")))
    up = F.when(long, F.lit(0.0)).otherwise(F.col("_sp"))
    stopped = F.when(long, F.col("low") <= F.col("_stop")).otherwise(F.col("high") + F.col("_sp") >= F.col("_stop"))
    won = F.when(long, F.col("high") >= F.col("_target")).otherwise(F.col("low") + F.col("_sp") <= F.col("_target"))
    first = lambda c: F.min(F.when(c, F.col("_rn")))
    r = j.groupBy(*own, "entry", "atr14").agg(first(stopped).alias("_s"), first(won).alias("_t"), first(stopped & won).alias("_w"), F.max("_rn").alias("_last"), F.max_by(F.col("close") + up, "_rn").alias("_close"))
    lost = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s") <= F.col("_t")))
    r = r.withColumn("outcome", F.when(lost, -1).when(F.col("_t").isNotNull(), 1).otherwise(0))
    r = r.withColumn("exit_rn", F.when(F.col("outcome") < 0, F.col("_s")).when(F.col("outcome") > 0, F.col("_t")).otherwise(F.col("_last")))
    moved = F.when(F.col("outcome") > 0, F.col("target")).when(F.col("outcome") < 0, -F.col("stop")).otherwise(F.col("side") * (F.col("_close") - F.col("entry")) / F.col("atr14"))
    x = r.select(*own, "exit_rn", "outcome", F.coalesce(F.col("_w") <= F.col("exit_rn"), F.lit(False)).alias("both"), (moved / F.col("stop")).alias("r"))
    return one_at_a_time(signals.select(*keys, *own).join(x, own), (*keys, "symbol"))


def screened(trades: DataFrame, *keys: str) -> DataFrame:
    """Figures of simulated trades: counts, win rate, R, profit factor (null without a loss), drawdown in R, bars held, timeouts, sides."""
    w = Window.partitionBy(*keys).orderBy("rn")
    t = trades.withColumn("_eq", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_eq").over(w.rowsBetween(Window.unboundedPreceding, 0))) - F.col("_eq"))
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("r") > 0).alias("wins"), F.avg("r").alias("expectancy_r"), F.sum("r").alias("total_r"), F.when(loss > 0, F.try_divide(gain, loss)).when(gain == 0, 0.0).alias("profit_factor"), F.max("_fall").alias("max_dd_r"),
        F.avg(F.col("exit_rn") - F.col("rn")).alias("bars_held"), F.count_if(F.col("outcome") == 0).alias("timeouts"), F.count_if("both").alias("ambiguous"), F.count_if(F.col("side") > 0).alias("longs"),
    )


def random_entries(bars: DataFrame, wanted: DataFrame, reps: int, most: int, warm_up: int = 250) -> DataFrame:
    """Controls of screened rules: keys of wanted, rep, symbol, rn, side; twice as many bars as a rule has trades, drawn by
    a hash of repetition and bar, with its share of longs. The first warm_up + 1 bars are left out; a symbol with fewer than
    20 bars to draw from has no controls. wanted: rule, symbol, trades, longs.
    """
    w = Window.partitionBy("symbol")
    eligible = bars.withColumn("_n", F.max("rn").over(w)).where((F.col("rn") > warm_up + 1) & (F.col("rn") < F.col("_n") - most - 1) & F.col("atr14").isNotNull())
    eligible = eligible.withColumn("_all", F.count(F.lit(1)).over(w)).where("_all >= 20").select("symbol", "rn")
    drawn = eligible.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    order = F.md5(F.concat_ws(":", F.col("symbol"), F.col("rep").cast("string"), F.col("rn").cast("string")))
    drawn = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "rep").orderBy(order, "rn")))
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("side"), F.col("rep").cast("string"), F.col("rn").cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
    wanted = wanted.where("trades >= 20")
    # ranks that no rule of the symbol asks for don't meet the rules
    needed = wanted.groupBy("symbol").agg((2 * F.max("trades")).alias("_most"))
    drawn = drawn.join(needed, "symbol").where(F.col("_k") <= F.col("_most")).drop("_most")
    j = drawn.join(wanted, "symbol").where(F.col("_k") <= 2 * F.col("trades"))
    return j.select("rule", "rep", "symbol", "rn", F.when(coin < F.col("longs") / F.col("trades"), 1).otherwise(-1).alias("side"))


def edges(found: DataFrame, controls: DataFrame) -> DataFrame:
    """Expectancy of each screened rule against its controls (rule, symbol, rep, trades, expectancy_r): edge_r, and edge_z in their population deviations."""
    c = controls.where("trades >= 5").groupBy("rule", "symbol").agg(F.avg("expectancy_r").alias("control_r"), F.stddev_pop("expectancy_r").alias("control_sd"))
    x = found.join(c, ["rule", "symbol"], "left").withColumn("edge_r", F.when(F.col("control_sd") > 0, F.col("expectancy_r") - F.col("control_r")))
    return x.withColumn("edge_z", F.try_divide("edge_r", "control_sd"))


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """How far price goes for and against a long from the next open within the horizon, in units of atr14."""
    w = Window.partitionBy("symbol").orderBy("time")
    ahead = w.rowsBetween(1, horizon)
    x = bars.withColumns({"entry": F.lead("open").over(w), "hi": F.max("high").over(ahead), "lo": F.min("low").over(ahead), "n": F.count("high").over(ahead)})
    x = x.where((F.col("n") == horizon) & (F.col("atr14") > 0))
    mfe, mae = (F.col("hi") - F.col("entry")) / F.col("atr14"), (F.col("entry") - F.col("lo")) / F.col("atr14")
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(mfe).alias("mfe"), F.percentile(mfe, F.lit(0.5)).alias("mfe_median"), F.avg(mae).alias("mae"), F.percentile(mae, F.lit(0.5)).alias("mae_median"))


def autocorrelation(bars: DataFrame, lags: list[int]) -> DataFrame:
    """Correlation of log returns with themselves some bars later; one pass for all lags."""
    w = Window.partitionBy("symbol").orderBy("time")
    r = bars.withColumn("r", F.log(F.col("close") / F.lag("close").over(w)))
    r = r.withColumns({f"r{k}": F.lag("r", k).over(w) for k in lags})
    wide = r.groupBy("symbol").agg(*[correlation("r", f"r{k}").alias(f"lag_{k}") for k in lags])
    return wide.unpivot("symbol", [f"lag_{k}" for k in lags], "lag", "correlation")
