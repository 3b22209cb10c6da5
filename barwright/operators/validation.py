"""Gates on signals, and what a result must stand: grids and shifts of exits, dearer costs, regimes, resampled paths, held-out time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators.bars import as_of
from barwright.operators.barriers import simulated_each
from barwright.operators.blocks import beside, framed
from barwright.operators.inference import PIECE, Fall, by_block, mixed, seeds, unpacked

#: Four hours UTC, midnight in New York in summer.
MIDNIGHT = 4 * 3600


def midnight_gate(signals: DataFrame, bars: DataFrame, span: int) -> DataFrame:
    """signals (symbol, time, signal) with midnight (the close of the last bar that began by 4:00 UTC of their IST day) and blocked.

    Below its 20-bar average a bar is bearish: its shorts are blocked beneath the midnight price; above, longs above it.
    Before 4:00 UTC nothing is blocked. bars: symbol, time, close, ema20; without an average nothing is blocked either.
    """
    at = cal.ist_day(F.col("time")).cast("long") * cal.DAY + MIDNIGHT
    s = signals.join(bars.select("symbol", "time", "close", "ema20"), ["symbol", "time"]).withColumn("_midnight", at)
    s = as_of(s, bars.select("symbol", F.col("time").alias("_at"), F.col("close").alias("midnight")), ["midnight"], span, "_midnight", "_at")
    s = s.withColumn("midnight", F.when(F.col("time") >= F.col("_midnight"), F.col("midnight")))
    bearish = F.col("close") <= F.col("ema20")
    blocked = F.when(bearish, (F.col("signal") < 0) & (F.col("close") < F.col("midnight"))).otherwise((F.col("signal") > 0) & (F.col("close") > F.col("midnight")))
    return s.withColumn("blocked", F.coalesce(F.col("ema20").isNotNull() & blocked, F.lit(False))).drop("_midnight")


def clean_reversals(bars: DataFrame) -> DataFrame:
    """bars (with rn and ema20) with against_long and against_short: a strong bar that closes beyond the bar before, or the close crosses its average."""
    w = beside()
    x = framed(bars, {"_h": F.lag("high").over(w), "_l": F.lag("low").over(w), "_c": F.lag("close").over(w), "_e": F.lag("ema20").over(w)}, 1)
    strong = F.abs(F.col("close") - F.col("open")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) > 0.55
    down = (F.col("close") < F.col("open")) & strong & (F.col("close") < F.col("_l"))
    up = (F.col("close") > F.col("open")) & strong & (F.col("close") > F.col("_h"))
    lost, won = (F.col("close") < F.col("ema20")) & (F.col("_c") >= F.col("_e")), (F.col("close") > F.col("ema20")) & (F.col("_c") <= F.col("_e"))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    return x.withColumns({"against_long": either(down, lost), "against_short": either(up, won)}).drop("_h", "_l", "_c", "_e")


def confluence(signals: DataFrame, structured: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """signals with agrees (their side is the trend's) and near (the close lies within so many ranges of their side's order block). structured: bars with structure() and atr14."""
    cols = ["close", "atr14", "trend", "bull_low", "bull_high", "bear_low", "bear_high"]
    s = signals.join(structured.select("symbol", "time", *cols), ["symbol", "time"])
    far = tolerance * F.col("atr14")
    within = lambda side: F.col("close").between(F.col(f"{side}_low") - far, F.col(f"{side}_high") + far)
    near = F.when(F.col("signal") > 0, within("bull")).otherwise(within("bear"))
    return s.withColumns({"agrees": F.col("trend") == F.col("signal"), "near": F.coalesce(near, F.lit(False))}).drop(*cols)


def exit_grid(bars: DataFrame, signals: DataFrame, exits: list[tuple[float, float]], hold: int) -> DataFrame:
    """Trades of signals (symbol, rn, side) for each pair of target and stop: target, stop, and simulated_each()'s columns. exits is a fixed list, not data."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.lit(float(s)).alias("stop")) for t, s in exits]))
    each = signals.withColumn("_x", pairs).select("symbol", "rn", "side", "_x.target", "_x.stop", F.lit(hold).alias("hold"))
    each = each.withColumn("exit", F.format_string("%.3f/%.3f", "target", "stop"))
    return simulated_each(bars, each, ("exit",), hold)


def cost_stress(bars: DataFrame, signals: DataFrame, multiples: list[float], hold: int) -> DataFrame:
    """Trades of signals (symbol, rn, side, target, stop) under spreads so many times as wide; the multiples are a short fixed list."""
    out = None
    for m in multiples:
        own = simulated_each(bars.withColumn("spread", F.col("spread") * m), signals.withColumns({"hold": F.lit(hold), "cost": F.lit(float(m))}), ("cost",), hold)
        out = own if out is None else out.unionByName(own)
    return out


def regimes(trades: DataFrame, bars: DataFrame, span: int, n: int = 480) -> DataFrame:
    """Results by regime: each trade (symbol, strategy, entry_time, net_pl) counts for its trend, its fifth of ranges and its strategy.

    The trend is the close of the last bar at the entry against the mean of the n bars before; fifths are cut over all of a
    symbol's ranges. Trades before n bars, or without a range, are left out. bars: symbol, time, rn, close, atr14.
    """
    before = beside().rowsBetween(-n, -1)
    x = framed(bars, {"_mean": F.when(F.count("close").over(before) == n, F.avg("close").over(before))}, n)
    cuts = bars.groupBy(F.col("symbol").alias("_k")).agg(F.percentile("atr14", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("_q"))
    x = x.join(cuts, F.col("symbol").eqNullSafe(F.col("_k"))).withColumns({"_fifth": F.size(F.filter("_q", lambda q: q < F.col("atr14"))), "_up": F.col("close") > F.col("_mean")})
    t = as_of(trades, x.select("symbol", F.col("time").alias("_at"), "_up", F.when(F.col("atr14").isNotNull(), F.col("_fifth")).alias("_fifth")), ["_up", "_fifth"], span, "entry_time", "_at").where("_up IS NOT NULL AND _fifth IS NOT NULL")
    keys = F.array(F.when(F.col("_up"), "trend_up").otherwise("trend_down"), F.concat(F.lit("range_"), F.col("_fifth").cast("string")), F.concat(F.lit("leg_"), "strategy"))
    g = t.withColumn("regime", F.explode(keys)).groupBy("regime")
    gain, loss = F.sum(F.greatest("net_pl", F.lit(0.0))), F.sum(F.greatest(-F.col("net_pl"), F.lit(0.0)))
    return g.agg(F.count(F.lit(1)).alias("trades"), F.when(loss > 0, F.try_divide(gain, loss)).alias("profit_factor"), F.sum("net_pl").alias("net_pl"), (100.0 * F.count_if(F.col("net_pl") > 0) / F.count(F.lit(1))).alias("win_rate"))


def resampled_paths(trades: DataFrame, sims: int, start: float, floors: tuple[float, ...] = (0.75, 0.5, 0.2), block: int = 250) -> DataFrame:
    """strategy, sim, profit_factor, drawdown_pct and touch_<per cent> of paths of n trades drawn with replacement from a strategy's n, in order of drawing.

    Draws come from a hash of place and simulation. A task takes ``block`` simulations of a strategy; of its trades it holds
    two numbers each, and of a path some thousand places at a time.
    """
    names = [f"touch_{round(100 * f)}" for f in floors]

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        pl = unpacked(pdf)[1]
        count, seed = np.uint32(len(pl)), seeds(np.arange(len(pl), dtype=np.int64))
        first, out = int(pdf["block"].iloc[0]) * block, []
        for sim in range(first, min(first + block, sims)):
            fall, won, lost = Fall(start, relative=True), 0.0, 0.0
            for lo in range(0, len(pl), PIECE):
                h = mixed(seed[lo : lo + PIECE], np.int64(sim))
                # the remainder; numpy divides faster than it takes one
                drawn = pl[h - h // count * count]
                fall.add(drawn)
                won, lost = won + float(np.maximum(drawn, 0.0).sum()), lost + float(np.maximum(-drawn, 0.0).sum())
            out.append((sim, won / lost if lost > 0 else np.nan, fall.most * 100, *(fall.least <= start * f for f in floors)))
        frame = pd.DataFrame(out, columns=["sim", "profit_factor", "drawdown_pct", *names])
        frame.insert(0, "strategy", pdf["strategy"].iloc[0])
        return frame

    schema = "strategy string, sim long, profit_factor double, drawdown_pct double, " + ", ".join(f"{n} boolean" for n in names)
    x = by_block(trades, (sims - 1) // block + 1).groupBy("strategy", "block").applyInPandas(paths, schema)
    return x.withColumn("profit_factor", F.when(~F.isnan("profit_factor"), F.col("profit_factor")))


def path_summary(paths: DataFrame, most_drawdown: float = 40.0, most_ruin: float = 1.0) -> DataFrame:
    """Quantiles of resampled_paths(), the share of paths (in per cent) that touch each floor, and whether the 95th drawdown and the deepest floor are within limits."""
    touches = [c for c in paths.columns if c.startswith("touch_")]
    q = [F.percentile(c, F.lit(p)).alias(f"{n}_p{round(100 * p)}") for c, n, ps in (("profit_factor", "pf", (0.05, 0.5, 0.95)), ("drawdown_pct", "drawdown", (0.5, 0.95))) for p in ps]
    x = paths.groupBy("strategy").agg(F.count(F.lit(1)).alias("sims"), *q, *[(100.0 * F.count_if(F.col(c)) / F.count(F.lit(1))).alias(c) for c in touches])
    deepest = min(touches, key=lambda c: int(c.split("_")[1]))
    return x.withColumn("passed", (F.col("drawdown_p95") < most_drawdown) & (F.col(deepest) < most_ruin))


def held_out(trades: DataFrame, split: float, start: float, least_pf: float = 1.2, most_drawdown: float = 40.0, least_balance: float = 0.5) -> DataFrame:
    """strategy, part (train, test), trades, win_rate, profit_factor, net_pl, least_balance, drawdown_pct and passed, of trades by exit before and after a share of each strategy's time. trades: strategy, trade_id, exit_time, net_pl."""
    t = trades.where("exit_time IS NOT NULL")
    span = t.groupBy(F.col("strategy").alias("_k")).agg(F.min("exit_time").alias("_a"), F.max("exit_time").alias("_b"))
    t = t.join(span, F.col("strategy").eqNullSafe(F.col("_k")))
    t = t.withColumn("part", F.when(F.col("exit_time") < F.col("_a") + (F.col("_b") - F.col("_a")) * split, "train").otherwise("test"))
    w = Window.partitionBy("strategy", "part").orderBy("exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    b = t.withColumn("_balance", start + F.sum("net_pl").over(w))
    b = b.withColumn("_peak", F.greatest(F.lit(start), F.max("_balance").over(w)))
    gain, loss = F.sum(F.greatest("net_pl", F.lit(0.0))), F.sum(F.greatest(-F.col("net_pl"), F.lit(0.0)))
    g = b.groupBy("strategy", "part").agg(
        F.count(F.lit(1)).alias("trades"), (100.0 * F.count_if(F.col("net_pl") > 0) / F.count(F.lit(1))).alias("win_rate"), F.when(loss > 0, F.try_divide(gain, loss)).alias("profit_factor"), F.sum("net_pl").alias("net_pl"),
        F.min("_balance").alias("least_balance"), F.max(100.0 * (F.col("_peak") - F.col("_balance")) / F.col("_peak")).alias("drawdown_pct"),
    )
    sound = (F.col("profit_factor").isNull() | (F.col("profit_factor") > least_pf)) & (F.col("drawdown_pct") < most_drawdown) & (F.col("least_balance") >= start * least_balance)
    return g.withColumn("passed", sound)
