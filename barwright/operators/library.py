"""The second rule library: factories of rules over a graph of level columns, and its registry.

A rule is two conditions over columns; what columns it names, its factory declares to the graph. The graph adds each column
once, whatever the number of rules: levels anchored in the calendar by joins with small tables of days and sessions, then
all row frames in one pass over chunks of rows with the longest look-back beside them. Signals of all rules come of one
pass over the bars. A candidate filters its rule's signals by side, and then keeps the first of each session, or none that
is within four bars of the last one kept.

A session's occurrence is a run of bars inside its hours; it is complete from the first bar outside on. Comparisons with a
missing value are false. Where both sides fire, the short one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators.bars import as_of
from barwright.operators.blocks import beside, cumulated, framed, numbered
from barwright.operators.chunkmaps import spaced
from barwright.operators.frames import candle_parts
from barwright.operators.recurrences import averages, ema, indicators
from barwright.staging import staged

#: Hours (IST), stops in ranges, spread ceilings in points and bands of the range's percentile; fixed values.
HOURS = {"ASIA": (2.5, 11.5), "LONDON": (11.5, 15.5), "OVERLAP": (15.5, 17.5), "NY": (17.5, 21.5), "LATE": (21.5, 26.5), "DAY_SESSION": (11.5, 21.5), "OVERNIGHT": (21.5, 35.5)}
STOPS = {"ASIA": 0.6, "LATE": 0.55, "LONDON": 0.7, "NY": 0.9, "OVERLAP": 1.1, "DAY_SESSION": 0.7}
SPREADS = {"TIGHT": 300.0, "NORMAL": 400.0, "LOOSE": 600.0}
REGIMES = {"ANY": (None, None), "COMPRESSED": (0.0, 0.4), "MID": (0.2, 0.8), "EXTENDED": (0.6, 1.0)}
#: Families that take one signal a session; the others take one in so many bars.
ONCE, APART = {"asian_breakout", "range_failure", "session_reversal", "opening_range", "noise_band"}, 4

#: Candidates in the order of their numbers: family | rule and its arguments | session, target in ranges, longest hold in bars, spread, regime, side. Fixed values.
REGISTRY = """
asian_breakout | range_break ASIA LONDON | LONDON 2.1 32 NORMAL ANY both
asian_breakout | range_break ASIA LONDON pct_lo=0.0 pct_hi=0.4 | LONDON 2.8 32 NORMAL COMPRESSED both
asian_breakout | range_break ASIA LONDON pct_lo=0.3 pct_hi=0.7 | LONDON 2.8 32 NORMAL MID both
asian_breakout | range_break ASIA LONDON max_width_band=0.5 | LONDON 2.8 32 TIGHT ANY both
asian_breakout | range_break ASIA LONDON buffer_atr=0.25 | LONDON 2.8 32 NORMAL ANY both
asian_breakout | range_break ASIA LONDON noise_band_k=0.15 | LONDON 2.8 32 NORMAL ANY both
asian_breakout | range_break ASIA LONDON side=short | LONDON 2.8 32 NORMAL ANY short
asian_breakout | range_break ASIA LONDON side=long | LONDON 2.8 32 NORMAL ANY long
asian_breakout | range_break_retest ASIA LONDON | LONDON 3.0 32 NORMAL ANY both
asian_breakout | range_break ASIA NY | NY 2.2 32 LOOSE ANY both
asian_breakout | range_break ASIA OVERLAP | OVERLAP 2.2 24 LOOSE ANY both
asian_breakout | range_break LATE ASIA | ASIA 2.5 32 TIGHT ANY both
asian_breakout | range_break LATE ASIA side=short | ASIA 2.5 32 TIGHT ANY short
asian_breakout | range_break LONDON NY | NY 2.2 32 LOOSE ANY both
asian_breakout | range_break ASIA LONDON | LONDON 2.8 32 LOOSE EXTENDED both
range_failure | range_break_failure ASIA LONDON | LONDON 2.5 24 NORMAL ANY both
range_failure | range_break_failure LATE ASIA | ASIA 2.5 24 TIGHT ANY both
range_failure | range_break_failure ASIA LONDON | LONDON 2.5 24 NORMAL ANY short
range_failure | range_break_failure LONDON NY | NY 2.2 24 LOOSE ANY both
session_reversal | session_move_fade ASIA LONDON 0.5 | LONDON 2.5 32 NORMAL ANY both
session_reversal | session_move_fade ASIA LONDON 1.0 | LONDON 3.0 32 NORMAL ANY both
session_reversal | session_move_fade ASIA LONDON 0.5 side=short | LONDON 2.5 32 NORMAL ANY short
session_reversal | session_move_fade ASIA LONDON 0.5 side=long | LONDON 2.5 32 NORMAL ANY long
session_reversal | session_move_fade OVERNIGHT DAY_SESSION 0.5 | DAY_SESSION 2.8 40 NORMAL ANY both
session_reversal | session_move_fade DAY_SESSION LATE 0.5 | LATE 2.6 20 TIGHT ANY both
session_reversal | session_move_fade DAY_SESSION LATE 0.5 side=short | LATE 2.6 20 TIGHT ANY short
session_reversal | close_position_fade ASIA LONDON | LONDON 2.5 32 NORMAL ANY both
session_reversal | close_position_fade LATE ASIA | ASIA 2.5 32 TIGHT ANY both
session_reversal | prev_day_return_fade ASIA 1.0 | ASIA 3.0 48 TIGHT ANY both
session_reversal | prev_day_return_fade ASIA 1.0 | ASIA 3.0 48 TIGHT ANY short
session_reversal | gap_fade ASIA 0.5 | ASIA 2.5 48 TIGHT ANY both
session_reversal | gap_fade LATE 0.5 | LATE 2.5 20 TIGHT ANY both
opening_range | orb ASIA 4 | ASIA 2.5 24 TIGHT ANY both
opening_range | orb_failure ASIA 4 | ASIA 2.5 24 TIGHT ANY both
opening_range | orb ASIA 2 | ASIA 2.5 24 TIGHT ANY both
opening_range | orb LONDON 4 | LONDON 2.5 24 NORMAL ANY both
opening_range | orb_failure LONDON 4 | LONDON 2.5 24 NORMAL ANY both
opening_range | orb LONDON 2 | LONDON 2.5 24 NORMAL ANY both
opening_range | orb NY 4 | NY 2.5 24 LOOSE ANY both
opening_range | orb_failure NY 4 | NY 2.5 24 LOOSE ANY both
opening_range | orb NY 2 | NY 2.5 24 LOOSE ANY both
opening_range | orb LATE 4 | LATE 2.5 24 TIGHT ANY both
opening_range | orb_failure LATE 4 | LATE 2.5 24 TIGHT ANY both
opening_range | orb LATE 2 | LATE 2.5 24 TIGHT ANY both
opening_range | orb LONDON 4 noise_band_k=0.1 | LONDON 2.8 24 NORMAL ANY both
opening_range | orb ASIA 4 noise_band_k=0.1 | ASIA 2.8 24 TIGHT ANY both
opening_range | orb LATE 4 noise_band_k=0.1 | LATE 2.8 18 TIGHT ANY both
opening_range | orb LONDON 4 side=short | LONDON 2.5 24 NORMAL ANY short
opening_range | orb ASIA 4 side=short | ASIA 2.5 24 TIGHT ANY short
opening_range | orb_retest LONDON 4 | LONDON 3.0 24 NORMAL ANY both
opening_range | orb_retest ASIA 4 | ASIA 3.0 24 TIGHT ANY both
opening_range | orb LONDON 4 | LONDON 2.8 24 NORMAL COMPRESSED both
opening_range | orb OVERLAP 2 | OVERLAP 2.2 12 LOOSE ANY both
liquidity_sweep | level_sweep_reclaim pdh_pdl | ASIA 3.0 48 TIGHT ANY both
liquidity_sweep | level_sweep_reclaim pdh_pdl | LATE 3.0 20 TIGHT ANY both
liquidity_sweep | level_sweep_reclaim pdh_pdl | LONDON 3.0 32 NORMAL ANY both
liquidity_sweep | level_sweep_reclaim pdh_pdl | NY 3.0 32 LOOSE ANY both
liquidity_sweep | level_sweep_reclaim pdh_pdl side=short | ASIA 3.0 48 TIGHT ANY short
liquidity_sweep | level_sweep_reclaim pdh_pdl side=long | ASIA 3.0 48 TIGHT ANY long
liquidity_sweep | level_sweep_reclaim asia | LONDON 3.0 32 NORMAL ANY both
liquidity_sweep | level_sweep_reclaim asia | LONDON 3.0 32 NORMAL ANY short
liquidity_sweep | level_sweep_reclaim late | ASIA 3.0 32 TIGHT ANY both
liquidity_sweep | level_sweep_reclaim pwh_pwl | ASIA 4.0 64 TIGHT ANY both
liquidity_sweep | level_sweep_reclaim pwh_pwl | LATE 4.0 20 TIGHT ANY both
liquidity_sweep | session_extreme_sweep ASIA | ASIA 2.5 24 TIGHT ANY both
liquidity_sweep | session_extreme_sweep LONDON | LONDON 2.5 16 NORMAL ANY both
liquidity_sweep | session_extreme_sweep LATE min_bars=6 | LATE 2.5 16 TIGHT ANY both
liquidity_sweep | equal_extremes_sweep | ASIA 3.0 32 TIGHT ANY both
liquidity_sweep | equal_extremes_sweep | LONDON 3.0 32 NORMAL ANY both
liquidity_sweep | daily_bias_sweep | ASIA 3.0 48 TIGHT ANY both
liquidity_sweep | daily_bias_sweep | LONDON 3.0 32 NORMAL ANY both
round_number | round_sweep 10.0 | ASIA 2.5 24 TIGHT ANY both
round_number | round_sweep 25.0 | ASIA 2.8 24 TIGHT ANY both
round_number | round_sweep 50.0 | ASIA 3.0 32 TIGHT ANY both
round_number | round_sweep 50.0 | LATE 3.0 20 TIGHT ANY both
round_number | round_sweep 50.0 | LONDON 3.0 32 NORMAL ANY both
round_number | round_sweep 50.0 side=short | ASIA 3.0 32 TIGHT ANY short
round_number | round_break 50.0 | ASIA 2.5 32 TIGHT ANY both
round_number | round_break 50.0 | LONDON 2.5 32 NORMAL ANY both
round_number | round_break 25.0 | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break day_open 0.25 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break day_open 0.4 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break day_open 0.6 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break day_open 0.4 LONDON | LONDON 2.5 32 NORMAL ANY both
noise_band | noise_band_break day_open 0.4 NY | NY 2.5 32 LOOSE ANY both
noise_band | noise_band_break day_open 0.4 LATE | LATE 2.5 18 TIGHT ANY both
noise_band | noise_band_break session_open 0.25 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break session_open 0.25 LATE | LATE 2.5 18 TIGHT ANY both
noise_band | noise_band_break prev_close 0.5 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_break day_open 0.4 ASIA side=short | ASIA 2.5 32 TIGHT ANY short
noise_band | noise_band_fade day_open 1.0 ASIA | ASIA 2.5 32 TIGHT ANY both
noise_band | noise_band_fade day_open 1.0 LATE | LATE 2.5 18 TIGHT ANY both
noise_band | noise_band_fade day_open 1.5 LATE | LATE 3.0 18 TIGHT ANY both
noise_band | noise_band_fade day_open 1.0 NY | NY 2.5 32 LOOSE ANY both
tod_volatility | tod_spike 3.0 continue | ASIA 2.5 24 TIGHT ANY both
tod_volatility | tod_spike 3.0 fade | ASIA 2.5 24 TIGHT ANY both
tod_volatility | tod_spike 3.0 continue | LATE 2.5 18 TIGHT ANY both
tod_volatility | tod_spike 3.0 fade | LATE 2.5 18 TIGHT ANY both
tod_volatility | tod_spike 4.0 continue | LONDON 2.5 24 NORMAL ANY both
tod_volatility | tod_quiet_break 8 0.6 | ASIA 2.8 32 TIGHT ANY both
tod_volatility | tod_quiet_break 8 0.6 | LATE 2.8 18 TIGHT ANY both
tod_volatility | tod_quiet_break 8 0.6 | LONDON 2.8 32 NORMAL ANY both
tod_volatility | tod_relative_move 8 2.0 fade | ASIA 2.5 24 TIGHT ANY both
tod_volatility | tod_relative_move 8 2.0 continue | ASIA 2.5 24 TIGHT ANY both
tod_volatility | tod_relative_move 8 2.0 fade | LATE 2.5 18 TIGHT ANY both
tod_volatility | tod_relative_move 8 2.5 fade | NY 2.5 24 LOOSE ANY both
structure | bos_retest 20 | ASIA 2.5 32 TIGHT ANY both
structure | bos_retest 20 | LONDON 2.5 32 NORMAL ANY both
structure | bos_retest 20 | LATE 2.5 18 TIGHT ANY both
structure | bos_retest 20 | ASIA 2.5 32 TIGHT ANY short
structure | choch 12 | ASIA 2.8 32 TIGHT ANY both
structure | choch 12 | LONDON 2.8 32 NORMAL ANY both
structure | choch 12 | LATE 2.8 18 TIGHT ANY both
structure | choch 12 | ASIA 2.8 32 TIGHT EXTENDED both
structure | displacement 1.5 continue | ASIA 2.5 24 TIGHT ANY both
structure | displacement 1.5 fade | ASIA 2.5 24 TIGHT ANY both
structure | displacement 1.5 continue | LONDON 2.5 24 NORMAL ANY both
structure | displacement 1.5 fade | LATE 2.5 18 TIGHT ANY both
structure | displacement 1.5 continue | ASIA 2.5 24 TIGHT ANY short
structure | fvg_entry continue | ASIA 2.5 24 TIGHT ANY both
structure | fvg_entry fade | ASIA 2.5 24 TIGHT ANY both
structure | fvg_entry continue | LONDON 2.5 24 NORMAL ANY both
structure | fvg_scored_entry 50 | LONDON 2.5 24 NORMAL ANY both
structure | fvg_scored_entry 50 | NY 2.5 24 LOOSE ANY both
structure | inside_break 2 | ASIA 2.5 24 TIGHT ANY both
structure | inside_break 2 | LATE 2.5 18 TIGHT ANY both
structure | inside_break 3 | ASIA 2.8 24 TIGHT ANY both
contraction | nr_break 7 | ASIA 2.5 24 TIGHT ANY both
contraction | nr_break 7 | LATE 2.5 18 TIGHT ANY both
contraction | nr_break 7 | LONDON 2.5 24 NORMAL ANY both
contraction | nr_break 4 | ASIA 2.5 24 TIGHT ANY both
contraction | squeeze break | ASIA 2.8 32 TIGHT COMPRESSED both
contraction | squeeze break | LONDON 2.8 32 NORMAL COMPRESSED both
contraction | squeeze break | LATE 2.8 18 TIGHT COMPRESSED both
contraction | squeeze fade | ASIA 2.5 24 TIGHT COMPRESSED both
contraction | range_pct_break 24 0.25 | ASIA 2.8 32 TIGHT ANY both
contraction | range_pct_break 24 0.25 | LATE 2.8 18 TIGHT ANY both
contraction | range_pct_break 24 0.25 | LONDON 2.8 32 NORMAL ANY both
contraction | coil_expand 12 | ASIA 2.5 24 TIGHT ANY both
contraction | coil_expand 12 | LONDON 2.5 24 NORMAL ANY both
contraction | coil_expand 12 | LATE 2.5 18 TIGHT ANY both
rejection | session_extreme_rejection ASIA | ASIA 2.5 24 TIGHT ANY both
rejection | session_extreme_rejection LONDON | LONDON 2.5 16 NORMAL ANY both
rejection | session_extreme_rejection LATE min_bars=4 | LATE 2.5 16 TIGHT ANY both
rejection | session_extreme_rejection ASIA | ASIA 2.5 24 TIGHT ANY short
rejection | session_extreme_rejection NY | NY 2.5 16 LOOSE ANY both
rejection | extension_exhaustion 8 2.0 | ASIA 2.5 24 TIGHT EXTENDED both
rejection | extension_exhaustion 8 2.0 | LATE 2.5 18 TIGHT EXTENDED both
rejection | extension_exhaustion 8 2.0 | LONDON 2.5 24 NORMAL EXTENDED both
rejection | extension_exhaustion 8 3.0 | ASIA 3.0 24 TIGHT ANY both
rejection | momentum_divergence 20 | ASIA 2.5 32 TIGHT ANY both
rejection | momentum_divergence 20 | LONDON 2.5 32 NORMAL ANY both
rejection | momentum_divergence 20 | ASIA 2.5 32 TIGHT ANY short
rejection | volume_climax 3.0 | ASIA 2.5 24 TIGHT ANY both
rejection | volume_climax 3.0 | LONDON 2.5 24 NORMAL ANY both
rejection | volume_climax 3.0 | LATE 2.5 18 TIGHT ANY both
rejection | three_push 6 | ASIA 2.5 24 TIGHT ANY both
rejection | three_push 6 | LONDON 2.5 24 NORMAL ANY both
rejection | three_push 6 | LATE 2.5 18 TIGHT ANY both
mean_reversion | session_open_revert ASIA 1.5 | ASIA 2.0 24 TIGHT ANY both
mean_reversion | session_open_revert LATE 1.5 | LATE 2.0 16 TIGHT ANY both
mean_reversion | session_open_revert ASIA 2.0 | ASIA 2.5 24 TIGHT ANY both
mean_reversion | session_open_revert LONDON 2.0 | LONDON 2.2 16 NORMAL ANY both
mean_reversion | session_open_revert ASIA 1.5 | ASIA 2.0 24 TIGHT ANY short
mean_reversion | session_vwap_revert ASIA 1.5 | ASIA 2.2 24 TIGHT ANY both
mean_reversion | session_vwap_revert LONDON 1.5 | LONDON 2.2 16 NORMAL ANY both
mean_reversion | session_vwap_revert LATE 1.5 | LATE 2.2 16 TIGHT ANY both
mean_reversion | session_vwap_revert NY 2.0 | NY 2.2 16 LOOSE ANY both
mean_reversion | bb_fade 20 2.0 | ASIA 2.0 24 TIGHT ANY both
mean_reversion | bb_fade 20 2.0 | LATE 2.0 16 TIGHT ANY both
mean_reversion | bb_fade 20 2.0 | ASIA 2.0 24 TIGHT COMPRESSED both
mean_reversion | prev_close_retest 0.25 | ASIA 2.5 32 TIGHT ANY both
mean_reversion | prev_close_retest 0.25 | LONDON 2.5 32 NORMAL ANY both
mtf_alignment | weekly_bias_break ASIA | ASIA 3.0 48 TIGHT ANY both
mtf_alignment | weekly_bias_break LONDON | LONDON 3.0 32 NORMAL ANY both
mtf_alignment | weekly_bias_break LATE | LATE 3.0 18 TIGHT ANY both
mtf_alignment | weekly_bias_break ASIA | ASIA 3.0 48 TIGHT ANY short
mtf_alignment | htf_pullback ASIA | ASIA 2.5 32 TIGHT ANY both
mtf_alignment | htf_pullback LONDON | LONDON 2.5 24 NORMAL ANY both
mtf_alignment | htf_pullback NY | NY 2.5 24 LOOSE ANY both
mtf_alignment | htf_pullback LATE | LATE 2.5 16 TIGHT ANY both
"""


class Graph:
    """Columns that rules need: levels by kind, and frames with the columns that they are made of."""

    def __init__(self) -> None:
        self.levels: set[tuple] = set()
        self.frames: dict[str, tuple[int, int, Callable[[], Column]]] = {}  # depth, look-back, column

    def _add(self, name: str, needs: list[str], back: int, made: Callable[[], Column]) -> str:
        known = [self.frames[n] for n in needs if n in self.frames]
        self.frames.setdefault(name, (1 + max((k[0] for k in known), default=0), back + max((k[1] for k in known), default=0), made))
        return name

    def plain(self, name: str, expr: str, *needs: str) -> str:
        """A column of the row itself."""
        return self._add(name, list(needs), 0, lambda: F.expr(expr))

    def lag(self, column: str, n: int) -> str:
        return self._add(f"{column}_lag{n}", [column], n, lambda: F.lag(column, n).over(beside()))

    def _rolled(self, kind: str, f: Callable[[str], Column], column: str, n: int) -> str:
        w = lambda: beside().rowsBetween(-n, -1)
        return self._add(f"{column}_{kind}{n}", [column], n, lambda: F.when(F.count(column).over(w()) == n, f(column).over(w())))

    def top(self, column: str, n: int) -> str:
        return self._rolled("top", F.max, column, n)

    def bottom(self, column: str, n: int) -> str:
        return self._rolled("bottom", F.min, column, n)

    def mean(self, column: str, n: int) -> str:
        return self._rolled("mean", F.avg, column, n)

    def deviation(self, column: str, n: int) -> str:
        return self._rolled("sd", F.stddev_pop, column, n)

    def last(self, session: str) -> str:
        """Prefix of the last completed occurrence's high, low, open, close, width and pct."""
        self.levels.add(("last", session))
        return f"last_{session.lower()}"

    def running(self, session: str) -> str:
        """Prefix of the current occurrence's high, low, open, bars and vwap up to the row."""
        self.levels.add(("run", session))
        return f"run_{session.lower()}"

    def opening(self, session: str, bars: int) -> str:
        """Prefix of the high and low of the current occurrence's first bars, once they are closed."""
        self.levels.add(("run", session))
        self.levels.add(("open", session, bars))
        return f"first{bars}_{session.lower()}"

    def computed(self, bars: DataFrame, span: int) -> DataFrame:
        """bars (symbol, time, prices, tick_volume) with rn and all columns that were asked for."""
        x = candle_parts(numbered(bars, span=span))
        x = averages(staged(indicators(x, span), "indicators"), [ema("ema800", "close", 800)], span)
        t = F.col("time")
        x = x.withColumns({"ist_hour": cal.ist_hour(t), "ist_day": cal.ist_day(t).cast("long"), "ist_week": cal.ist_week(t).cast("long")})
        x = _periods(staged(_slots(x), "calendar"))
        sessions = sorted({k[1] for k in self.levels} | {k for k in HOURS if k in STOPS})
        x = staged(cumulated(x, {f"out_{s.lower()}": F.when(cal.in_session(F.col("ist_hour"), *HOURS[s]), 0).otherwise(1) for s in sessions}), "sessions")
        for kind, session, *size in sorted(self.levels, key=str, reverse=True):
            if kind == "run":
                x = _running(x, session, sorted(k[2] for k in self.levels if k[:2] == ("open", session)))
        for kind, session, *_ in sorted(self.levels, key=str):
            if kind == "last":
                x = _last(staged(x, "levels"), session)
        depths = max((d for d, _, _ in self.frames.values()), default=0)
        steps = [{n: made() for n, (d, _, made) in self.frames.items() if d == k} for k in range(1, depths + 1)]
        return framed(staged(x, "levels"), steps, max((b for _, b, _ in self.frames.values()), default=0))


def _slots(x: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """slot_norm: the mean true range of the slot's last n bars, this one excluded."""
    w = Window.partitionBy("symbol", F.pmod(F.col("time"), F.lit(cal.DAY))).orderBy("time").rowsBetween(-n, -1)
    return x.withColumn("slot_norm", F.when(F.count("true_range").over(w) >= least, F.avg("true_range").over(w)))


def _periods(x: DataFrame, days: int = 14) -> DataFrame:
    """pd_ and pw_ levels of the day and week before, day_open, and day_range, the mean range of the 14 days before."""
    for period, prefix in (("ist_day", "pd"), ("ist_week", "pw")):
        w = Window.partitionBy("_k").orderBy("_p")  # a row for each day or week
        p = x.groupBy(F.col("symbol").alias("_k"), F.col(period).alias("_p")).agg(F.min_by("open", "rn").alias("_open"), F.max("high").alias("_high"), F.min("low").alias("_low"), F.max_by("close", "rn").alias("_close"))
        p = p.withColumn("_range", F.col("_high") - F.col("_low"))
        own = [F.lag(f"_{c}").over(w).alias(f"{prefix}_{c}") for c in ("open", "high", "low", "close")]
        if prefix == "pd":
            f = w.rowsBetween(-days, -1)
            own += [F.col("_open").alias("day_open"), F.when(F.count("_range").over(f) == days, F.avg("_range").over(f)).alias("day_range")]
        x = x.join(p.select("_k", "_p", *own), F.col("symbol").eqNullSafe(F.col("_k")) & (F.col(period) == F.col("_p"))).drop("_k", "_p")
    return x


def _running(x: DataFrame, session: str, openings: list[int]) -> DataFrame:
    inside, out, name = cal.in_session(F.col("ist_hour"), *HOURS[session]), f"out_{session.lower()}", f"run_{session.lower()}"
    w = Window.partitionBy("symbol", out, inside).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    run = {"high": F.max("high"), "low": F.min("low"), "open": F.first("open"), "bars": F.count(F.lit(1)), "vwap": None}
    cols = {f"{name}_{k}": F.when(inside, f.over(w)) for k, f in run.items() if f is not None}
    cols[f"{name}_vwap"] = F.when(inside, F.try_divide(F.sum(F.col("close") * F.col("tick_volume")).over(w), F.sum("tick_volume").over(w)))
    x = x.withColumns(cols)
    n = F.col(f"{name}_bars")
    more = {f"first{k}_{session.lower()}_{c}": F.when(n >= k, f(F.when(n <= k, F.col(c))).over(w)) for k in openings for c, f in (("high", F.max), ("low", F.min))}
    return x.withColumns(more) if more else x


def _last(x: DataFrame, session: str, held: int = 20, least: int = 5) -> DataFrame:
    """High, low, open, close and width of the last completed occurrence, and the share of the 20 widths before that are less (a width that is equal to the last one isn't taken again)."""
    out, name = f"out_{session.lower()}", f"last_{session.lower()}"
    inside = x.where(cal.in_session(F.col("ist_hour"), *HOURS[session]))
    o = inside.groupBy("symbol", F.col(out).alias("_o")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "rn").alias("open"), F.max_by("close", "rn").alias("close"))
    w = Window.partitionBy("symbol").orderBy("_o")  # a row for each occurrence
    o = o.withColumn("width", F.col("high") - F.col("low"))
    o = o.withColumn("_new", ~F.col("width").eqNullSafe(F.lag("width").over(w)))
    new = o.where("_new")
    new = new.withColumn("_held", F.collect_list("width").over(w.rowsBetween(-held, -1)))
    new = new.select(F.col("symbol").alias("_k"), F.col("_o").alias("_o2"), F.when(F.size("_held") >= least, F.size(F.filter("_held", lambda v: v < F.col("width"))) / F.size("_held")).alias("_pct"))
    o = o.join(new, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("_o") == F.col("_o2")), "left")
    o = o.withColumn("_at", F.last(F.when(F.col("_new"), F.col("_o")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    o = o.withColumn("pct", F.first("_pct").over(Window.partitionBy("symbol", "_at").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    values = [f"{name}_{c}" for c in ("high", "low", "open", "close", "width", "pct")]
    o = o.select("symbol", (F.col("_o") + 1).alias("_seen"), *[F.col(v.rsplit("_", 1)[1]).alias(v) for v in values])
    return as_of(x, o, values, 1024, out, "_seen")


def inside(session: str) -> str:
    a, b = HOURS[session]
    return f"(ist_hour >= {a} AND ist_hour < {b})" if b <= 24 else f"(ist_hour >= {a} OR ist_hour < {b - 24})"


def _sided(long: str, short: str, side: str = "both") -> tuple[str, str]:
    return ("false" if side == "short" else long), ("false" if side == "long" else short)


def _buffer(buffer_atr: float, noise_band_k: float) -> str:
    return f"({buffer_atr} * atr14" + (f" + {noise_band_k} * day_range)" if noise_band_k else ")")


def _returned(g: Graph, high: str, low: str, name: str) -> tuple[str, str]:
    """Closes beyond a level on the bar before, and now again after touching it."""
    up, down = g.plain(f"{name}_up", f"close > {high}", high), g.plain(f"{name}_down", f"close < {low}", low)
    return f"{g.lag(up, 1)} AND low <= {high} AND close > {high}", f"{g.lag(down, 1)} AND high >= {low} AND close < {low}"


def range_break(g, src, trade, pct_lo=0.0, pct_hi=1.0, max_width_band=99.0, buffer_atr=0.0, noise_band_k=0.0, side="both"):
    p, buffer = g.last(src), _buffer(buffer_atr, noise_band_k)
    gate = f"{inside(trade)} AND (day_range IS NULL OR {p}_width <= {max_width_band} * day_range) AND ({p}_pct IS NULL OR {p}_pct BETWEEN {pct_lo} AND {pct_hi})"
    return _sided(f"{gate} AND close > {p}_high + {buffer}", f"{gate} AND close < {p}_low - {buffer}", side)


def range_break_retest(g, src, trade):
    p = g.last(src)
    up, down = _returned(g, f"{p}_high", f"{p}_low", f"beyond_{p}")
    return f"{inside(trade)} AND {up}", f"{inside(trade)} AND {down}"


def range_break_failure(g, src, trade):
    p = g.last(src)
    return f"{inside(trade)} AND low < {p}_low AND close > {p}_low AND close > open", f"{inside(trade)} AND high > {p}_high AND close < {p}_high AND close < open"


def _faded(move: str, k: float, trade: str, side: str = "both"):
    big = f"{inside(trade)} AND abs({move}) > {k} * day_range"
    return _sided(f"{big} AND {move} < 0", f"{big} AND {move} > 0", side)


def session_move_fade(g, src, trade, k=0.5, side="both"):
    p = g.last(src)
    return _faded(f"({p}_close - {p}_open)", k, trade, side)


def prev_day_return_fade(g, trade, k=1.0):
    return _faded("(pd_close - pd_open)", k, trade)


def gap_fade(g, trade, k=0.5):
    return _faded("(day_open - pd_close)", k, trade)


def close_position_fade(g, src, trade, edge=0.2):
    p = g.last(src)
    at = f"({p}_close - {p}_low) / greatest({p}_width, 1e-9)"
    return f"{inside(trade)} AND {at} <= {edge}", f"{inside(trade)} AND {at} >= {1.0 - edge}"


def orb(g, session, bars, buffer_atr=0.0, noise_band_k=0.0, side="both"):
    p, buffer = g.opening(session, bars), _buffer(buffer_atr, noise_band_k)
    return _sided(f"close > {p}_high + {buffer}", f"close < {p}_low - {buffer}", side)


def orb_failure(g, session, bars):
    p = g.opening(session, bars)
    up, down = g.lag(g.plain(f"over_{p}", f"high > {p}_high", f"{p}_high"), 1), g.lag(g.plain(f"under_{p}", f"low < {p}_low", f"{p}_low"), 1)
    return f"{down} AND close > {p}_low AND close > open", f"{up} AND close < {p}_high AND close < open"


def orb_retest(g, session, bars):
    p = g.opening(session, bars)
    return _returned(g, f"{p}_high", f"{p}_low", f"beyond_{p}")


def level_sweep_reclaim(g, level, side="both", wick=0.3):
    high, low = {"pdh_pdl": ("pd_high", "pd_low"), "pwh_pwl": ("pw_high", "pw_low")}.get(level) or tuple(f"{g.last(level.upper())}_{c}" for c in ("high", "low"))
    return _sided(f"low < {low} AND close > {low} AND lower_wick / range > {wick}", f"high > {high} AND close < {high} AND upper_wick / range > {wick}", side)


def daily_bias_sweep(g):
    up, down = level_sweep_reclaim(g, "pdh_pdl")
    return f"{up} AND NOT coalesce({down}, false) AND pd_close > pd_open", f"{down} AND pd_close < pd_open"


def round_sweep(g, step, tol=0.25, side="both"):
    level = f"(bround(close / {step}) * {step})"
    near = f"abs(close - {level}) < {tol} * atr14"
    return _sided(f"{near} AND low < {level} AND close > {level} AND lower_wick / range > 0.3", f"{near} AND high > {level} AND close < {level} AND upper_wick / range > 0.3", side)


def round_break(g, step, buffer=0.2):
    level, before = f"(bround(close / {step}) * {step})", g.lag("close", 1)
    return f"{before} < {level} AND close > {level} + {buffer} * atr14", f"{before} > {level} AND close < {level} - {buffer} * atr14"


def equal_extremes_sweep(g, n=20, tol=0.15):
    high, low = g.top("high", n), g.bottom("low", n)
    alike = lambda c: f"abs({c} - {g.lag(c, n)}) < {tol} * atr14"
    return f"{alike(low)} AND low < {low} AND close > {low}", f"{alike(high)} AND high > {high} AND close < {high}"


def session_extreme_sweep(g, session, min_bars=8, wick=0.4):
    p = g.running(session)
    high, low = g.lag(f"{p}_high", 1), g.lag(f"{p}_low", 1)
    return f"{p}_bars >= {min_bars} AND low < {low} AND close > {low} AND lower_wick / range > {wick}", f"{p}_bars >= {min_bars} AND high > {high} AND close < {high} AND upper_wick / range > {wick}"


def session_extreme_rejection(g, session, wick=0.5, min_bars=6):
    p = g.running(session)
    return f"{p}_bars >= {min_bars} AND low <= {g.lag(f'{p}_low', 1)} AND lower_wick / range > {wick}", f"{p}_bars >= {min_bars} AND high >= {g.lag(f'{p}_high', 1)} AND upper_wick / range > {wick}"


def _anchor(g, anchor, session):
    return {"day_open": "day_open", "prev_close": "pd_close"}.get(anchor) or f"{g.running(session)}_open"


def noise_band_break(g, anchor, k, session, side="both"):
    a = _anchor(g, anchor, session)
    return _sided(f"{inside(session)} AND close > {a} + {k} * day_range", f"{inside(session)} AND close < {a} - {k} * day_range", side)


def noise_band_fade(g, anchor, k, session):
    return noise_band_break(g, anchor, k, session)[::-1]


def _either(up: str, down: str, mode: str):
    return (down, up) if mode == "fade" else (up, down)


def tod_spike(g, k, mode="continue"):
    return _either(f"true_range > {k} * slot_norm AND close > open", f"true_range > {k} * slot_norm AND close < open", mode)


def tod_quiet_break(g, n=8, k=0.6):
    quiet = g.plain(f"quiet_{int(k * 100)}", f"CASE WHEN true_range < {k} * slot_norm THEN 1.0 ELSE 0.0 END")
    calm = f"{g.mean(quiet, n)} >= 0.99"
    return f"{calm} AND close > {g.top('high', n)}", f"{calm} AND close < {g.bottom('low', n)}"


def _moved(g, n, unit):
    """Move over n bars in a unit that is known and at least 1e-9."""
    return f"(close - {g.lag('close', n)}) / nullif(greatest({unit}, 1e-9), if({unit} IS NULL, 1e-9, null))"


def tod_relative_move(g, n=8, k=2.0, mode="fade"):
    move = _moved(g, n, "slot_norm")
    return _either(f"{move} > {k}", f"{move} < -{k}", mode)


def extension_exhaustion(g, n=8, k=2.0, wick=0.35):
    move = _moved(g, n, "atr14")
    return f"{move} < -{k} AND lower_wick / range > {wick}", f"{move} > {k} AND upper_wick / range > {wick}"


def bos_retest(g, n=20):
    high, low = g.top("high", n), g.bottom("low", n)
    up, down = g.lag(g.plain(f"over_{high}", f"close > {high}", high), 1), g.lag(g.plain(f"under_{low}", f"close < {low}", low), 1)
    high, low = g.lag(high, 1), g.lag(low, 1)
    return f"{up} AND low <= {high} AND close > {high}", f"{down} AND high >= {low} AND close < {low}"


def choch(g, n=12):
    high, low = g.top("high", n), g.bottom("low", n)
    h, lo = g.lag(high, n), g.lag(low, n)
    return f"{high} < {h} AND {low} < {lo} AND close > {high}", f"{high} > {h} AND {low} > {lo} AND close < {low}"


def displacement(g, k=1.5, mode="continue", share=0.6):
    big = f"body > {k} * atr14 AND body / range > {share}"
    return _either(f"{big} AND close > open", f"{big} AND close < open", mode)


def _gaps(g):
    h1, l1, h3, l3 = g.lag("high", 1), g.lag("low", 1), g.lag("high", 3), g.lag("low", 3)
    return f"{h3} < {l1} AND low <= {l1} AND close > {h3}", f"{l3} > {h1} AND high >= {h1} AND close < {l3}"


def fvg_entry(g, mode="continue"):
    return _either(*_gaps(g), mode)


def fvg_scored_entry(g, least):
    """Gap, displacement, trend, freshness and place in points. The averages are 0 points while they aren't known."""
    up, down = _gaps(g)
    h1, l1, h3, l3 = g.lag("high", 1), g.lag("low", 1), g.lag("high", 3), g.lag("low", 3)
    o2, c2, span2, unit = g.lag("open", 2), g.lag("close", 2), f"greatest({g.lag('high', 2)} - {g.lag('low', 2)}, 1e-9)", g.lag("atr14", 2)
    part = lambda v: f"30 * least(greatest({v}, 0.0), 1.0)"

    def score(gap: str, body: str, trend: str, place: str) -> str:
        return f"({part(f'{gap} / nullif(greatest({unit}, 1e-9), if({unit} IS NULL, 1e-9, null))')} + {part(f'{body} / {span2}')} + if({trend}, 20, 0) + 10 + if({place}, 10, 0)) >= {least} AND {unit} IS NOT NULL"

    return f"{up} AND {score(f'({l1} - {h3})', f'({c2} - {o2})', 'close > ema200', 'close < ema800')}", f"{down} AND {score(f'({l3} - {h1})', f'({o2} - {c2})', 'close < ema200', 'close > ema800')}"


def inside_break(g, n=2):
    high, low = g.lag("high", n + 1), g.lag("low", n + 1)
    held = " AND ".join(f"{g.lag('high', k)} < {high} AND {g.lag('low', k)} > {low}" for k in range(1, n + 1))
    return f"{held} AND close > {high}", f"{held} AND close < {low}"


def nr_break(g, n=7):
    narrow = f"{g.lag('range', 1)} <= {g.lag(g.bottom('range', n), 1)}"
    return f"{narrow} AND close > {g.lag('high', 1)}", f"{narrow} AND close < {g.lag('low', 1)}"


def squeeze(g, mode="break", n=20):
    mean, sd = g.mean("close", n), g.deviation("close", n)
    tight = g.lag(g.plain(f"squeezed{n}", f"2 * {sd} < 1.5 * atr14", mean, sd), 1)
    return _either(f"{tight} AND close > {mean} + 2 * {sd}", f"{tight} AND close < {mean} - 2 * {sd}", mode)


def range_pct_break(g, n=24, pct=0.25):
    high, low = g.top("high", n), g.bottom("low", n)
    # widths that aren't known yet count as 0
    usual = g.mean(g.plain(f"width{n}", f"coalesce({high} - {low}, 0.0)", high, low), 200)
    tight = f"{high} - {low} < {2 * pct} * {usual}"
    return f"{tight} AND close > {high}", f"{tight} AND close < {low}"


def coil_expand(g, n=12):
    coil = f"atr14 < {g.lag('atr14', n)} AND range > 2 * {g.lag('atr14', 1)}"
    return f"{coil} AND close > open", f"{coil} AND close < open"


def momentum_divergence(g, n=20):
    return f"low < {g.bottom('low', n)} AND rsi14 > {g.bottom('rsi14', n)}", f"high > {g.top('high', n)} AND rsi14 < {g.top('rsi14', n)}"


def volume_climax(g, k=3.0, wick=0.4):
    big = f"tick_volume > {k} * {g.mean('tick_volume', 50)}"
    return f"{big} AND lower_wick / range > {wick}", f"{big} AND upper_wick / range > {wick}"


def three_push(g, n=6):
    high, low = g.top("high", n), g.bottom("low", n)
    return f"{low} < {g.lag(low, n)} AND {g.lag(low, n)} < {g.lag(low, 2 * n)} AND close > {g.lag('high', 1)}", f"{high} > {g.lag(high, n)} AND {g.lag(high, n)} > {g.lag(high, 2 * n)} AND close < {g.lag('low', 1)}"


def _reverted(distance: str, k: float):
    return f"atr14 IS NOT NULL AND {distance} < -{k} * greatest(atr14, 1e-9)", f"atr14 IS NOT NULL AND {distance} > {k} * greatest(atr14, 1e-9)"


def session_open_revert(g, session, k=1.5):
    p = g.running(session)
    return tuple(f"{p}_bars >= 4 AND {c}" for c in _reverted(f"close - {p}_open", k))


def session_vwap_revert(g, session, k=1.5):
    return _reverted(f"close - {g.running(session)}_vwap", k)


def bb_fade(g, n=20, k=2.0):
    mean, sd = g.mean("close", n), g.deviation("close", n)
    return f"low < {mean} - {k} * {sd} AND close > {mean} - {k} * {sd}", f"high > {mean} + {k} * {sd} AND close < {mean} + {k} * {sd}"


def prev_close_retest(g, k=0.25):
    before = g.lag("close", 4)
    near = f"abs(close - pd_close) < {k} * atr14 AND abs({before} - pd_close) > {4 * k} * atr14"
    return f"{near} AND {before} < pd_close", f"{near} AND {before} > pd_close"


def weekly_bias_break(g, session):
    bull = "coalesce(close > (pw_high + pw_low) / 2, false)"
    return f"{inside(session)} AND {bull} AND close > {g.top('high', 20)}", f"{inside(session)} AND NOT {bull} AND close < {g.bottom('low', 20)}"


def htf_pullback(g, session):
    p, before = g.running(session), g.lag("close", 1)
    return f"{p}_bars >= 4 AND pd_close > pd_open AND {before} < {p}_open AND close > {p}_open", f"{p}_bars >= 4 AND pd_close < pd_open AND {before} > {p}_open AND close < {p}_open"


def _arguments(words: list[str]) -> tuple[list, dict]:
    value = lambda v: int(v) if v.isdigit() else float(v) if v.replace(".", "", 1).isdigit() else v
    return [value(w) for w in words if "=" not in w], {w.split("=")[0]: value(w.split("=")[1]) for w in words if "=" in w}


def candidates(prefix: str = "XV2") -> list[dict]:
    """The registry's rows."""
    out = []
    for n, line in enumerate(REGISTRY.strip().split("\n"), 1):
        family, rule, (session, target, hold, spread, regime, side) = [x.strip() if k < 2 else x.split() for k, x in enumerate(line.split("|"))]
        out.append({"id": f"{prefix}-{n:03d}", "family": family, "rule": rule, "session": session, "target": float(target), "stop": STOPS[session], "hold": int(hold), "spread": SPREADS[spread], "least_pct": REGIMES[regime][0], "most_pct": REGIMES[regime][1], "side": side, "once": family in ONCE})
    return out


def rule_signals(bars: DataFrame, span: int, wanted: list[str] | None = None) -> DataFrame:
    """symbol, time, rn, rule, signal of each distinct rule of the registry, and the numbers of the sessions' occurrences."""
    graph, conditions = Graph(), {}
    for rule in dict.fromkeys(wanted or [c["rule"] for c in candidates()]):
        name, *words = rule.split()
        args, named = _arguments(words)
        conditions[rule] = globals()[name](graph, *args, **named)
    x = staged(graph.computed(bars, span), "library")
    true = lambda c: F.coalesce(F.expr(c), F.lit(False))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.when(true(short), -1).when(true(long), 1).otherwise(0).alias("signal")) for r, (long, short) in conditions.items()])
    occurrences = [f"out_{s.lower()}" for s in STOPS]
    return x.select("symbol", "time", "rn", "ist_hour", *occurrences, F.explode(F.filter(each, lambda s: s["signal"] != 0)).alias("s")).select("symbol", "time", "rn", "ist_hour", *occurrences, "s.rule", "s.signal")


def candidate_signals(signals: DataFrame, listed: list[dict]) -> DataFrame:
    """symbol, time, rn, id, signal of the candidates, from rule_signals(). The list is the registry's fixed one, not data."""
    spark = signals.sparkSession
    c = spark.createDataFrame([(x["id"], x["rule"], x["session"], x["side"], x["once"]) for x in listed], "id string, rule string, session string, side string, once boolean")
    x = signals.join(F.broadcast(c), "rule").where((F.col("side") == "both") | (F.col("side") == F.when(F.col("signal") > 0, "long").otherwise("short")))
    within, occurrence = F.lit(False), F.lit(None).cast("long")
    for s in STOPS:
        within = F.when(F.col("session") == s, F.expr(inside(s))).otherwise(within)
        occurrence = F.when(F.col("session") == s, F.col(f"out_{s.lower()}")).otherwise(occurrence)
    x = staged(x.select("symbol", "time", "rn", "id", "signal", "once", within.alias("within"), occurrence.alias("occurrence")), "candidates")
    first = F.row_number().over(Window.partitionBy("symbol", "id", "occurrence").orderBy("rn"))
    once = x.where("once AND within").withColumn("_first", first).where("_first = 1")
    apart = spaced(x.where("NOT once"), ["symbol", "id"], "rn", None, APART)
    cols = ["symbol", "time", "rn", "id", "signal"]
    return once.select(*cols).unionByName(apart.select(*cols))
