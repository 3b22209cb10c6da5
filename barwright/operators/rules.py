"""Signal rules: a condition for long and one for short over a bar's features; -1, 0 or 1.

Conditions are SQL over the columns that features() gives. Short is tested first; null conditions are false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.frames import candle_parts, rolled, rolling_features, series
from barwright.operators.chunkmaps import spaced
from barwright.operators.folds import parabolic_sar
from barwright.operators.recurrences import averages, ema, indicators
from barwright.operators.structure import structure
from barwright.staging import staged


@dataclass(frozen=True)
class Rule:
    name: str
    family: str
    long: str
    short: str


RULES = [
    Rule("ema_stack", "trend", "ema20 > ema50 AND ema50 > ema200 AND close > ema20", "ema20 < ema50 AND ema50 < ema200 AND close < ema20"),
    Rule("donchian_break", "trend", "close > hh20", "close < ll20"),
    Rule("donchian_break_adx", "trend", "close > hh20 AND adx14 > 25", "close < ll20 AND adx14 > 25"),
    Rule("pullback_ema20", "trend", "ema50 > ema200 AND low_1 <= ema20 AND close > ema20", "ema50 < ema200 AND high_1 >= ema20 AND close < ema20"),
    Rule("momentum_roc", "trend", "(close - close_12) > 1.0 * atr14", "(close - close_12) < -1.0 * atr14"),
    Rule("zscore_revert", "reversion", "close - mean40 < -2 * sd40", "close - mean40 > 2 * sd40"),
    Rule("bb_fade", "reversion", "low < band_low AND close > band_low", "high > band_up AND close < band_up"),
    Rule("rsi_extreme", "reversion", "rsi_1 < 25 AND rsi14 >= 25", "rsi_1 > 75 AND rsi14 <= 75"),
    Rule("atr_exhaustion", "reversion", "(close - close_8) < -2.5 * atr14", "(close - close_8) > 2.5 * atr14"),
    Rule("range_rejection", "reversion", "low <= ll24 AND lower_wick > 0.5 * range", "high >= hh24 AND upper_wick > 0.5 * range"),
    Rule("failed_breakout", "reversion", "low < ll20 AND close > ll20 AND close > open", "high > hh20 AND close < hh20 AND close < open"),
    Rule("vwap_revert", "reversion", "(close - vwap48) < -1.5 * atr14", "(close - vwap48) > 1.5 * atr14"),
    Rule("squeeze_break", "volatility", "squeeze_1 AND close > band_up", "squeeze_1 AND close < band_low"),
    Rule("atr_expansion", "volatility", "atr14 > 1.5 * atr_mean20 AND close > open", "atr14 > 1.5 * atr_mean20 AND close < open"),
    Rule("nr7_break", "volatility", "range_1 <= range_min7_1 AND close > high_1", "range_1 <= range_min7_1 AND close < low_1"),
    Rule("low_vol_revert", "volatility", "atr14 < 0.7 * atr_mean50 AND close - mean20 < -1.5 * sd20", "atr14 < 0.7 * atr_mean50 AND close - mean20 > 1.5 * sd20"),
    Rule("opening_break", "session", "close > hh4", "close < ll4"),
    Rule("session_sweep_revert", "session", "low < ll32 AND close > ll32", "high > hh32 AND close < hh32"),
    Rule("prev_day_level", "session", "low <= ll96 AND close > ll96", "high >= hh96 AND close < hh96"),
    Rule("displacement", "structure", "body > 1.5 * atr14 AND close > open", "body > 1.5 * atr14 AND close < open"),
    Rule("fair_value_gap", "structure", "high_2 < low", "low_2 > high"),
    Rule("fair_value_gap_macd", "structure", "high_2 < low AND macd_hist > 0", "low_2 > high AND macd_hist < 0"),
    Rule("liquidity_sweep", "structure", "low < ll12 AND close > ll12 AND lower_wick > 0.4 * range", "high > hh12 AND close < hh12 AND upper_wick > 0.4 * range"),
    Rule("break_retest", "structure", "close_1 > hh20_1 AND low <= hh20_1 AND close > hh20_1", "close_1 < ll20_1 AND high >= ll20_1 AND close < ll20_1"),
    Rule("engulfing", "structure", "close > open AND close_1 < open_1 AND close > open_1 AND open < close_1", "close < open AND close_1 > open_1 AND close < open_1 AND open > close_1"),
    Rule("inside_bar_break", "structure", "high_1 < high_2 AND low_1 > low_2 AND close > high_1", "high_1 < high_2 AND low_1 > low_2 AND close < low_1"),
    Rule("higher_high_structure", "trend", "hh10 > hh10_10 AND ll10 > ll10_10 AND close > ema20", "hh10 < hh10_10 AND ll10 < ll10_10 AND close < ema20"),
]

#: Rules over states of the market: stop-and-reverse, structure breaks, order blocks. Conditions over state_features().
STATE_RULES = [
    Rule("ema_sar_full", "confluence", "ema7 > ema21 AND ema21 > ema200 AND close > ema7 AND close > sar AND adx14 > 25 AND low < ll5 AND tick_volume > volume_mean20", "ema7 < ema21 AND ema21 < ema200 AND close < ema7 AND close < sar AND adx14 > 25 AND high > hh5 AND tick_volume > volume_mean20"),
    Rule("ema_sar_simple", "confluence", "close > ema200 AND close > sar", "close < ema200 AND close < sar"),
    Rule("structure_break_choch", "structure", "event = 2", "event = -2"),
    Rule("structure_break_bos", "structure", "event = 1", "event = -1"),
    Rule("order_block", "structure", "low <= bull_high AND close >= bull_low AND close > open", "high >= bear_low AND close <= bear_high AND close < open"),
]


def state_features(bars: DataFrame, chunk: int = 30 * 86_400) -> DataFrame:
    """Every column that STATE_RULES name."""
    w = series()
    x = indicators(candle_parts(bars), chunk)
    x = parabolic_sar(averages(staged(x, "indicators"), [ema("ema7", "close", 7), ema("ema21", "close", 21)], chunk))
    x = x.withColumns({"hh5": rolled(F.max("high"), "high", 5, w), "ll5": rolled(F.min("low"), "low", 5, w), "volume_mean20": rolled(F.avg("tick_volume"), "tick_volume", 20, w)})
    return structure(staged(x, "state"))


def features(bars: DataFrame) -> DataFrame:
    """Every column that RULES name."""
    w = series()
    x = indicators(rolling_features(candle_parts(bars)))
    x = x.withColumns({f"{k}{n}": rolled(F.max("high") if k == "hh" else F.min("low"), "high" if k == "hh" else "low", n, w) for k in ("hh", "ll") for n in (4, 10, 12, 24, 32, 96)})
    x = x.withColumns({
        "atr_mean20": rolled(F.avg("atr14"), "atr14", 20, w), "atr_mean50": rolled(F.avg("atr14"), "atr14", 50, w), "_min7": rolled(F.min("range"), "range", 7, w),
        "mean20": rolled(F.avg("close"), "close", 20, w), "sd20": rolled(F.stddev_pop("close"), "close", 20, w),
    })
    # bands of the 20 bars before, and whether they lie within a channel of 1.5 ranges around the same mean
    x = x.withColumns({"band_up": F.col("mean20") + 2 * F.col("sd20"), "band_low": F.col("mean20") - 2 * F.col("sd20"), "_squeeze": 2 * F.col("sd20") < 1.5 * F.col("atr14")})
    lags = {f"{c}_{n}": F.lag(c, n).over(w) for c, n in [("open", 1), ("high", 1), ("low", 1), ("close", 1), ("high", 2), ("low", 2), ("close", 8), ("close", 12), ("range", 1), ("hh20", 1), ("ll20", 1), ("hh10", 10), ("ll10", 10)]}
    return x.withColumns(lags | {"rsi_1": F.lag("rsi14").over(w), "range_min7_1": F.lag("_min7").over(w), "squeeze_1": F.lag("_squeeze").over(w)}).drop("_min7", "_squeeze")


def every_feature(bars: DataFrame, chunk: int = 30 * 86_400) -> DataFrame:
    """What RULES and STATE_RULES name, with the indicators computed once."""
    w = series()
    x = staged(features(bars), "features")
    x = parabolic_sar(averages(x, [ema("ema7", "close", 7), ema("ema21", "close", 21)], chunk))
    x = x.withColumns({"hh5": rolled(F.max("high"), "high", 5, w), "ll5": rolled(F.min("low"), "low", 5, w), "volume_mean20": rolled(F.avg("tick_volume"), "tick_volume", 20, w)})
    return structure(staged(x.drop("rn"), "state"))


def signals(featured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """symbol, time, rule, family, signal: a row for each rule that fires. One pass over the bars, no join."""
    side = lambda r: F.when(F.coalesce(F.expr(r.short), F.lit(False)), -1).when(F.coalesce(F.expr(r.long), F.lit(False)), 1).otherwise(0)
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.family).alias("family"), side(r).alias("signal")) for r in rules])
    return featured.select("symbol", "time", F.explode(F.filter(each, lambda s: s["signal"] != 0)).alias("s")).select("symbol", "time", "s.rule", "s.family", "s.signal")


def debounced(sig: DataFrame, bars_apart: int, keys: tuple[str, ...] = ("symbol", "rule")) -> DataFrame:
    """Signals (with rn, the number of their bar) at least so many bars after the last one kept, greedily."""
    return spaced(sig, list(keys), "rn", None, bars_apart)


def library_summary(sig: DataFrame) -> DataFrame:
    """What a library fires by family, and in all (family null): rules, signals, longs, symbols."""
    return sig.rollup("family").agg(F.count_distinct("rule").alias("rules"), F.count(F.lit(1)).alias("signals"), F.count_if(F.col("signal") > 0).alias("longs"), F.count_distinct("symbol").alias("symbols"))
