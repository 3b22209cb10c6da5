"""The registry of candidates: each rule over sessions and exits, numbered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions import calendar as cal

#: Hours (IST) of sessions and barriers in ranges (target, stop); fixed values.
HOURS = {"LONDON": (11.5, 15.5), "NY": (17.5, 21.5), "ALL": (11.5, 21.5), "ASIA": (2.5, 11.5)}
WIDE, BOTH = [(3.0, 1.5)], [(3.0, 1.5), (1.5, 1.5)]
MAIN, OPENS = ("LONDON", "NY", "ALL"), ("LONDON", "NY", "ASIA")
#: Rules in the order of their numbers; those with both exits (fixed values).
ORDER = (
    "ema_stack donchian_break donchian_break_adx pullback_ema20 momentum_roc higher_high_structure zscore_revert bb_fade rsi_extreme atr_exhaustion range_rejection failed_breakout vwap_revert squeeze_break atr_expansion nr7_break low_vol_revert "
    "opening_break session_sweep_revert prev_day_level displacement fair_value_gap fair_value_gap_macd liquidity_sweep break_retest engulfing inside_bar_break ema_sar_full ema_sar_simple structure_break_choch structure_break_bos order_block"
).split()
TWO_EXITS = set("ema_stack donchian_break pullback_ema20 zscore_revert bb_fade rsi_extreme failed_breakout opening_break session_sweep_revert liquidity_sweep ema_sar_full ema_sar_simple structure_break_choch structure_break_bos order_block".split())


def candidates(prefix: str = "XAU") -> list[tuple[str, str, str, float, float]]:
    """(id, rule, session, target, stop) of every candidate."""
    rows = [(r, s, *x) for r in ORDER for s in (OPENS if r == "opening_break" else MAIN) for x in (BOTH if r in TWO_EXITS else WIDE)]
    return [(f"{prefix}-{n:03d}", *row) for n, row in enumerate(rows, 1)]


def candidate_signals(signals: DataFrame, listed: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """signals (symbol, time, rule, signal) of each candidate, those of its rule within its session: id, session, target and stop are added. The list is the registry's fixed one, not data."""
    spark = signals.sparkSession
    rows = [(i, r, s, t, x, *HOURS[s]) for i, r, s, t, x in listed]
    c = spark.createDataFrame(rows, "id string, rule string, session string, target double, stop double, _a double, _b double")
    hour = cal.ist_hour(F.col("time"))
    return signals.join(F.broadcast(c), "rule").where((hour >= F.col("_a")) & (hour < F.col("_b"))).drop("_a", "_b")
