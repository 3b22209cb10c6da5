"""Trades: summaries, buckets, drawdown, streaks, outliers, comparison. Columns: trade_id, strategy, is_buy, entry_time, exit_time, session, net_pl, r."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.functions.numeric import profit_factor, safe_div


def trades_of(ticks: DataFrame, risk: float = 25.0) -> DataFrame:
    """A trade for each tick: its result is the price's distance from 50, its exit the symbol's next tick."""
    w = Window.partitionBy("symbol").orderBy("micros", "event_id")
    net = F.col("price") - 50.0
    return ticks.select(
        F.col("event_id").alias("trade_id"), F.col("symbol").alias("strategy"), (F.col("event_id") % 2 == 0).alias("is_buy"), F.col("t").alias("entry_time"), F.lead("t").over(w).alias("exit_time"),
        cal.session_of(cal.ist_hour(F.col("t"))).alias("session"), net.alias("net_pl"), (net / risk).alias("r"),
    )


def _sums(pl: Column) -> list[Column]:
    gain, loss = F.when(pl > 0, pl).otherwise(0.0), F.when(pl > 0, 0.0).otherwise(F.abs(pl))
    return [F.count(F.lit(1)).alias("trades"), F.count_if(pl > 0).alias("wins"), F.sum(pl).alias("net_pl"), F.sum(gain).alias("gross_profit"), F.sum(loss).alias("gross_loss")]


def buckets(trades: DataFrame, *keys: Column | str) -> DataFrame:
    """Trades, wins, net, gross, win rate and profit factor by keys; a result of zero counts as a loss."""
    b = trades.groupBy(*keys).agg(*_sums(F.col("net_pl")))
    return b.withColumns({"win_rate": 100.0 * F.col("wins") / F.col("trades"), "profit_factor": profit_factor(F.col("gross_profit"), F.col("gross_loss"))})


def summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Rates, averages, medians, payoff, expectancy, R statistics and Sortino ratio of each group."""
    pl = F.col("net_pl")
    win, loss = F.when(pl > 0, pl), F.when(pl < 0, -pl)
    s = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.count_if(pl == 0).alias("scratches"), F.sum(pl).alias("net_pl"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.avg(pl).alias("expectancy"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.percentile(win, F.lit(0.5)).alias("median_win"), F.percentile(loss, F.lit(0.5)).alias("median_loss"),
        F.sum("r").alias("total_r"), F.avg("r").alias("expectancy_r"), F.stddev_pop(loss).alias("downside"),
    )
    return s.withColumns({
        "win_rate": 100.0 * F.col("wins") / F.col("trades"), "profit_factor": profit_factor(F.col("gross_profit"), F.col("gross_loss")), "payoff": safe_div(F.col("avg_win"), F.col("avg_loss")),
        "breakeven": F.try_divide(100.0 * F.col("avg_loss"), F.col("avg_win") + F.col("avg_loss")), "sortino": safe_div(F.col("expectancy"), F.col("downside")),
    }).drop("downside")


def drawdown(trades: DataFrame, start: float) -> DataFrame:
    """Largest fall of each strategy's realized balance from its peak, that fall in per cent of the peak, the longest time under a peak in days, and net result over the fall.

    The balance moves at exits, in order of exit; it begins at the first entry. A peak is renewed only by a higher
    balance. Trades without an exit are open and have no part. A peak of zero gives 0 per cent, no fall a ratio of 0.
    """
    w = Window.partitionBy("strategy").orderBy("exit_time", "trade_id")
    run, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    t = trades.where("exit_time IS NOT NULL")
    b = t.withColumns({"balance": start + F.sum("net_pl").over(run), "_began": F.min("entry_time").over(Window.partitionBy("strategy"))})
    b = b.withColumn("_peak_before", F.greatest(F.lit(start), F.coalesce(F.max("balance").over(before), F.lit(start))))
    b = b.withColumns({"peak": F.greatest("_peak_before", "balance"), "_renewed": F.when(F.col("balance") > F.col("_peak_before"), F.col("exit_time"))})
    b = b.withColumns({"fall": F.col("peak") - F.col("balance"), "days": (F.col("exit_time") - F.coalesce(F.last("_renewed", ignorenulls=True).over(run), F.col("_began"))) / 86400.0})
    pct = F.coalesce(F.try_divide(100.0 * F.col("fall"), F.col("peak")), F.lit(0.0))
    out = b.groupBy("strategy").agg(F.max("fall").alias("max_drawdown"), F.max_by(pct, F.struct("fall", -F.col("exit_time"))).alias("drawdown_pct"), F.max("days").alias("longest_days"), F.max_by("balance", F.struct("exit_time", "trade_id")).alias("end_balance"), F.sum("net_pl").alias("_net"))
    return out.withColumn("recovery", F.coalesce(F.try_divide("_net", "max_drawdown"), F.lit(0.0))).drop("_net")


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of wins and of losses; a zero result breaks neither."""
    t = trades.where("net_pl <> 0").withColumn("won", F.col("net_pl") > 0)
    w, v = Window.partitionBy("strategy").orderBy("entry_time", "trade_id"), Window.partitionBy("strategy", "won").orderBy("entry_time", "trade_id")
    island = F.row_number().over(w) - F.row_number().over(v)
    runs = t.withColumn("island", island).groupBy("strategy", "won", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("strategy").agg(F.max(F.when(F.col("won"), F.col("n"))).alias("max_wins"), F.max(F.when(~F.col("won"), F.col("n"))).alias("max_losses"))


def without_outliers(trades: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Net result of each strategy without its k best, and without its k worst trades."""
    w = Window.partitionBy("strategy")
    t = trades.withColumns({"best": F.row_number().over(w.orderBy(F.desc("net_pl"), "trade_id")), "worst": F.row_number().over(w.orderBy("net_pl", "trade_id"))})
    return t.groupBy("strategy").agg(F.sum("net_pl").alias("net_pl"), *[x for k in ks for x in (F.sum(F.when(F.col("best") > k, F.col("net_pl"))).alias(f"without_best_{k}"), F.sum(F.when(F.col("worst") > k, F.col("net_pl"))).alias(f"without_worst_{k}"))])


def daily(trades: DataFrame, start: float) -> DataFrame:
    """Result of each IST day of exits, with the running balance over the days."""
    d = trades.where("exit_time IS NOT NULL").groupBy(cal.ist_day(F.col("exit_time")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pl").alias("net_pl"))
    # one row a day: the only table that a single window may hold
    return d.withColumn("balance", start + F.sum("net_pl").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def rolling_factor(trades: DataFrame, n: int = 30) -> DataFrame:
    """Profit factor of each strategy's last n trades, and which tripwire it crosses; none of both below n trades. Without a loss the factor has no limit: null and ok."""
    w = Window.partitionBy("strategy").orderBy(F.desc("entry_time"), F.desc("trade_id"))
    last = trades.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    b = buckets(last, "strategy")
    full = F.col("trades") >= n
    return b.select("strategy", "trades", F.when(full, F.col("profit_factor")).alias("profit_factor"), F.when(~full, None).when(F.col("profit_factor") < 0.8, "halt").when(F.col("profit_factor") < 1.0, "warn").otherwise("ok").alias("tripwire"))


def leave_one_out(trades: DataFrame) -> DataFrame:
    """The portfolio's totals without each strategy, by subtraction."""
    b = buckets(trades, "strategy")
    every = Window.partitionBy()
    return b.select("strategy", *[(F.sum(c).over(every) - F.col(c)).alias(f"other_{c}") for c in ("trades", "net_pl", "gross_profit", "gross_loss")])


def composite(trades: DataFrame) -> DataFrame:
    """Strategies by a weighted score of their measures, each relative to the best (0 where none has any)."""
    b = buckets(trades, "strategy")
    every = Window.partitionBy()
    parts = {"profit_factor": 0.3, "win_rate": 0.3, "gross_profit": 0.2, "trades": 0.2}
    score = sum((F.lit(w) * F.coalesce(F.try_divide(F.col(c), F.max(c).over(every)), F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return b.select("strategy", score.alias("score"), F.row_number().over(Window.orderBy(F.desc(score), "strategy")).alias("place"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two reports' figures (metric, value) side by side with the better one; equal ones tie."""
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric", "full")
    return j.withColumn("better", F.when(F.col("a") == F.col("b"), "tie").when(F.col("b").isNull() | (F.col("a") > F.col("b")), "a").otherwise("b"))


def regimes(trades: DataFrame, regime: DataFrame) -> DataFrame:
    """Buckets by each of several labels at once: a trade counts once for every kind of label. regime: trade_id, labels (array<struct<kind, label>>)."""
    t = trades.join(regime, "trade_id").withColumn("l", F.explode("labels"))
    return buckets(t, F.col("l.kind").alias("kind"), F.col("l.label").alias("label"))


def delay_penalty(trades: DataFrame, delays: list[tuple[str, float]]) -> DataFrame:
    """Net result and profit factor if each trade loses a penalty for a delay: a small table of delays, exploded."""
    grid = F.array(*[F.struct(F.lit(n).alias("delay"), F.lit(p).alias("penalty")) for n, p in delays])
    t = trades.withColumn("d", F.explode(grid)).select("strategy", "d.delay", (F.col("net_pl") - F.col("d.penalty")).alias("net_pl"))
    return buckets(t, "strategy", "delay")
