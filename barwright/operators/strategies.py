"""Strategies as columns: two conditions each over the level graph, and what a strategy remembers.

Conditions name only what is known when the bar has closed. Averages run over the whole series, not anew over the last few
hundred bars. What is remembered: nothing; that the bar before gave the same signal (``edge``: only the first bar of a run
counts); or that the day had its signal (``utc`` or ``ist``: the first of the day, which must also be in the session).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators.blocks import beside, framed, numbered
from barwright.operators.frames import candle_parts
from barwright.operators.library import Graph
from barwright.operators.ratchets import qqe, supertrend
from barwright.operators.recurrences import averages, ema, indicators
from barwright.staging import staged

DAY = 86_400


@dataclass(frozen=True)
class Strategy:
    name: str
    build: Callable[[Graph], tuple[str, str]]
    session: tuple[float, float] | None = None
    memory: str | None = None


def trend_pullback(g: Graph) -> tuple[str, str]:
    fast, slow, low, high, before = g.lag("ema13", 1), g.lag("ema34", 1), g.lag("low", 1), g.lag("high", 1), g.lag("close", 1)
    return f"{fast} > {slow} AND ema13 > ema34 AND {low} <= {fast} AND close > {before} AND close > ema13", f"{fast} < {slow} AND ema13 < ema34 AND {high} >= {fast} AND close < {before} AND close < ema13"


def band_reversion(g: Graph) -> tuple[str, str]:
    return "close < now_mean20 - 2 * now_sd20 AND rsi14 < 35", "close > now_mean20 + 2 * now_sd20 AND rsi14 > 65"


def session_breakout(g: Graph) -> tuple[str, str]:
    before = g.lag("close", 1)
    return f"range_bars >= 4 AND close > range_high AND {before} <= range_high", f"range_bars >= 4 AND close < range_low AND {before} >= range_low"


def asia_volatile_break(g: Graph) -> tuple[str, str]:
    gate = "asia_bars >= 16 AND atr14 > atr_median"
    return f"{gate} AND close > asia_high", f"{gate} AND close < asia_low"


def daily_open_momentum(g: Graph) -> tuple[str, str]:
    return "utc_first <= 7200 AND close - utc_open > 0.8 * atr14 AND ema50 > ema200", "utc_first <= 7200 AND utc_open - close > 0.8 * atr14 AND ema50 < ema200"


def open_drive(g: Graph) -> tuple[str, str]:
    """Four bars of a quarter hour from 12:30 on, against the range of the bar before."""
    t3, unit, o = g.lag("time", 3), g.lag("atr14", 4), g.lag("open", 3)
    ready = f"ist_hour = 13.25 AND time - {t3} = 2700 AND {t3} - {g.lag('time', 4)} <= 3600 AND {unit} > 0"
    side = lambda c: " + ".join(f"if({a} {c} {b}, 1, 0)" for a, b in [("close", "open"), *((g.lag("close", k), g.lag("open", k)) for k in (1, 2, 3))])
    return f"{ready} AND close - {o} >= {unit} AND {side('>')} >= 3", f"{ready} AND {o} - close >= {unit} AND {side('<')} >= 3"


def range_fade(g: Graph) -> tuple[str, str]:
    return "atr14 > 0 AND close - ema20 < -atr14", "atr14 > 0 AND close - ema20 > atr14"


def overlap_momentum(g: Graph) -> tuple[str, str]:
    a, b = g.lag("close", 20), g.lag("close", 5)
    return f"close > {a} AND close > {b} AND close < open", f"close < {a} AND close < {b} AND close > open"


def _crossed(g: Graph, up: str, down: str) -> tuple[str, str]:
    before = g.lag("close", 1)
    return f"{before} <= {g.lag(up, 1)} AND close > {up}", f"{before} >= {g.lag(down, 1)} AND close < {down}"


def keltner_break(g: Graph) -> tuple[str, str]:
    return _crossed(g, g.plain("keltner_up", "ema20 + 2 * atr14"), g.plain("keltner_low", "ema20 - 2 * atr14"))


def macd_cross(g: Graph) -> tuple[str, str]:
    line, signal = g.lag("macd", 1), g.lag("macd_signal", 1)
    return f"close > ema200 AND {line} <= {signal} AND macd > macd_signal", f"close < ema200 AND {line} >= {signal} AND macd < macd_signal"


def volume_pullback(g: Graph) -> tuple[str, str]:
    near, gate = g.lag("ema20", 1), "tick_volume > now_volume20 AND rsi14 BETWEEN 35 AND 65"
    return f"{gate} AND close > ema50 AND ema50 > ema200 AND {g.lag('low', 1)} <= {near} * 1.001 AND close > ema20", f"{gate} AND close < ema50 AND ema50 < ema200 AND {g.lag('high', 1)} >= {near} * 0.999 AND close < ema20"


def ribbon(g: Graph) -> tuple[str, str]:
    return "ema20 > ema50 AND ema50 > ema200 AND close > ema20", "ema20 < ema50 AND ema50 < ema200 AND close < ema20"


def previous_day_break(g: Graph) -> tuple[str, str]:
    before = g.lag("close", 1)
    return f"{before} <= utc_prev_high AND close > utc_prev_high", f"{before} >= utc_prev_low AND close < utc_prev_low"


def morning_range_break(g: Graph) -> tuple[str, str]:
    """The range of the first eight hours of the UTC day, left in the next two."""
    gate, before = "pmod(time, 86400) BETWEEN 28800 AND 35999 AND morning_high - morning_low <= 50", g.lag("close", 1)
    return f"{gate} AND {before} <= morning_high AND close > morning_high", f"{gate} AND {before} >= morning_low AND close < morning_low"


def trend_flip(g: Graph) -> tuple[str, str]:
    before = g.lag("direction", 1)
    return f"{before} < 0 AND direction > 0 AND close > ema200", f"{before} > 0 AND direction < 0 AND close < ema200"


def momentum_flip(g: Graph) -> tuple[str, str]:
    before = g.lag("trend", 1)
    return f"{before} < 0 AND trend > 0", f"{before} > 0 AND trend < 0"


def asia_sweep(g: Graph) -> tuple[str, str]:
    """Through an edge of the morning's range and back inside by the close."""
    gate = "range_bars >= 4 AND atr14 > 0 AND range_high - range_low >= 0.3 * atr14"
    return f"{gate} AND low < range_low AND close > range_low", f"{gate} AND high > range_high AND close < range_high"


def session_mean(g: Graph) -> tuple[str, str]:
    """Far from the mean of the evening's closes so far."""
    gate, far = "evening_bars >= 4 AND evening_sd >= 0.5", "(close - evening_mean) / nullif(evening_sd, 0)"
    return f"{gate} AND {far} < -1.7 AND rsi14 < 35", f"{gate} AND {far} > 1.7 AND rsi14 > 65"


def day_raid(g: Graph) -> tuple[str, str]:
    """Beyond an extreme of the calendar day before and back, unless price has run far from its average."""
    gate = "day_bars >= 4 AND atr14 > 0 AND coalesce(abs(close - ema20) <= 3 * atr14, true)"
    return f"{gate} AND low < day_low - 0.05 * atr14 AND close > day_low", f"{gate} AND high > day_high + 0.05 * atr14 AND close < day_high"


STRATEGIES = [
    Strategy("trend_pullback", trend_pullback, (11.5, 21.5), "edge"), Strategy("band_reversion", band_reversion, (17.5, 21.5)), Strategy("session_breakout", session_breakout, (11.5, 13.5), "edge"),
    Strategy("asia_volatile_break", asia_volatile_break, (11.5, 23.5), "ist"), Strategy("daily_open_momentum", daily_open_momentum, (5.5, 23.5), "utc"), Strategy("open_drive", open_drive, (12.5, 13.5)),
    Strategy("range_fade", range_fade, (2.0, 9.0)), Strategy("overlap_momentum", overlap_momentum, (18.0, 22.0)), Strategy("keltner_break", keltner_break), Strategy("macd_cross", macd_cross), Strategy("volume_pullback", volume_pullback, (15.5, 21.5)),
    Strategy("ribbon", ribbon), Strategy("ribbon_asia", ribbon, (2.5, 11.5), "edge"), Strategy("previous_day_break", previous_day_break), Strategy("morning_range_break", morning_range_break), Strategy("trend_flip", trend_flip), Strategy("momentum_flip", momentum_flip, (11.5, 15.5)),
    Strategy("asia_sweep", asia_sweep, (11.5, 15.5)), Strategy("session_mean", session_mean, (17.5, 21.5)), Strategy("day_raid", day_raid, (11.5, 21.5)),
]


def _days(x: DataFrame) -> DataFrame:
    """utc_open, utc_first (seconds of the day's first bar), utc_prev_high and utc_prev_low, and ranges of parts of a day, known once that part is over."""
    x = x.withColumns({"utc_day": F.floor(F.col("time") / DAY), "ist_day": cal.ist_day(F.col("time")).cast("long"), "ist_hour": cal.ist_hour(F.col("time"))})
    second = F.pmod(F.col("time"), F.lit(DAY))
    w = Window.partitionBy("_k").orderBy("_d")  # a row for each day
    utc = x.groupBy(F.col("symbol").alias("_k"), F.col("utc_day").alias("_d")).agg(
        F.min_by("open", "time").alias("utc_open"), F.min(second).alias("utc_first"), F.max("high").alias("_h"), F.min("low").alias("_l"),
        F.max(F.when(second < 28_800, F.col("high"))).alias("morning_high"), F.min(F.when(second < 28_800, F.col("low"))).alias("morning_low"),
    ).withColumns({"utc_prev_high": F.lag("_h").over(w), "utc_prev_low": F.lag("_l").over(w)}).drop("_h", "_l")
    asia = (F.col("ist_hour") >= 2.5) & (F.col("ist_hour") < 11.5)
    ist = x.where(asia).groupBy(F.col("symbol").alias("_k"), F.col("ist_day").alias("_d")).agg(F.max("high").alias("asia_high"), F.min("low").alias("asia_low"), F.count(F.lit(1)).alias("asia_bars"))
    x = x.join(utc, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("utc_day") == F.col("_d"))).drop("_k", "_d")
    x = x.join(ist, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("ist_day") == F.col("_d")), "left").drop("_k", "_d")
    day = x.groupBy(F.col("symbol").alias("_k"), (F.col("ist_day") + 1).alias("_d")).agg(F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.count(F.lit(1)).alias("day_bars"))
    x = x.join(day, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("ist_day") == F.col("_d")), "left").drop("_k", "_d")
    evening = F.col("ist_hour") >= 17.5
    so_far = Window.partitionBy("symbol", "ist_day", evening).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({n: F.when(evening, f.over(so_far)) for n, f in (("evening_mean", F.avg("close")), ("evening_sd", F.stddev_pop("close")), ("evening_bars", F.count(F.lit(1))))})
    # a bar of the session itself doesn't know the session's range
    return x.withColumns({c: F.when(F.col("ist_hour") >= 11.5, F.col(c)) for c in ("asia_high", "asia_low", "asia_bars")})


def features(bars: DataFrame, graph: Graph, span: int) -> DataFrame:
    """What STRATEGIES name, from bars (symbol, time, prices, tick_volume)."""
    x = candle_parts(numbered(bars, span=span))
    x = indicators(x, span)
    x = averages(staged(x, "indicators"), [ema("ema13", "close", 13), ema("ema34", "close", 34)], span)
    x = supertrend(staged(x, "averages"), span).drop("upper_band", "lower_band", "supertrend")
    x = _days(staged(qqe(staged(x, "directions"), span).drop("rsi_ma", "longband", "shortband"), "trends"))
    w = beside()
    now = lambda f, c, n: F.when(F.count(c).over(w.rowsBetween(-n + 1, 0)) == n, f.over(w.rowsBetween(-n + 1, 0)))
    held = F.array_sort(F.collect_list("atr14").over(w.rowsBetween(-99, 0)))
    recent, inside = w.rowsBetween(-100, -1), (F.col("ist_hour") >= 5.5) & (F.col("ist_hour") < 11.5)
    own = {
        "now_mean20": now(F.avg("close"), "close", 20), "now_sd20": now(F.stddev_pop("close"), "close", 20), "now_volume20": now(F.avg("tick_volume"), "tick_volume", 20),
        "atr_median": F.when(F.size(held) == 100, (held[49] + held[50]) / 2), "range_high": F.max(F.when(inside, F.col("high"))).over(recent), "range_low": F.min(F.when(inside, F.col("low"))).over(recent), "range_bars": F.count(F.when(inside, 1)).over(recent),
    }
    depths = max((d for d, _, _ in graph.frames.values()), default=0)
    steps = [{n: made() for n, (d, _, made) in graph.frames.items() if d == k} for k in range(1, depths + 1)]
    return framed(staged(x, "days"), [own, *steps], max(100, *(b for _, b, _ in graph.frames.values())))


def signals(bars: DataFrame, span: int, strategies: list[Strategy] = STRATEGIES) -> DataFrame:
    """symbol, time, strategy, signal. Where both sides fire, the long one counts."""
    graph = Graph()
    built = {s.name: s.build(graph) for s in strategies}
    x = staged(features(bars, graph, span), "strategies")
    true = lambda c: F.coalesce(F.expr(c), F.lit(False))
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), F.when(true(long), 1).when(true(short), -1).otherwise(0).alias("signal")) for n, (long, short) in built.items()])
    s = x.select("symbol", "time", "rn", "ist_hour", "ist_day", "utc_day", F.explode(F.filter(each, lambda e: e["signal"] != 0)).alias("s")).select("*", "s.strategy", "s.signal").drop("s")
    kind = lambda value, none: F.coalesce(*[F.when(F.col("strategy") == t.name, value(t)) for t in strategies], none)
    inside = kind(lambda t: cal.in_session(F.col("ist_hour"), *t.session) if t.session else F.lit(True), F.lit(True))
    memory = kind(lambda t: F.lit(t.memory), F.lit("none"))
    s = staged(s.withColumns({"inside": inside, "memory": memory}), "signals")
    # a run: the same signal on the bar before, in the session
    before = s.where("inside").select(F.col("symbol").alias("_k"), F.col("strategy").alias("_n"), (F.col("rn") + 1).alias("_rn"), F.col("signal").alias("_was"))
    s = s.join(before, F.col("symbol").eqNullSafe(F.col("_k")) & (F.col("strategy") == F.col("_n")) & (F.col("rn") == F.col("_rn")), "left")
    day = F.when(F.col("memory") == "utc", F.col("utc_day")).when(F.col("memory") == "ist", F.col("ist_day")).otherwise(F.col("rn"))
    # the first of an IST day is the first in the session; that of a UTC day is the first at all
    place = F.when((F.col("memory") == "ist") & ~F.col("inside"), 1).otherwise(0)
    first = F.row_number().over(Window.partitionBy("symbol", "strategy", day, place).orderBy("rn"))
    s = s.withColumn("_first", first)
    return s.where("inside AND _first = 1 AND NOT (memory = 'edge' AND coalesce(_was = signal, false))").select("symbol", "time", "strategy", "signal")


def hourly_channel(hours: DataFrame, n: int = 100, span: int = 30 * DAY) -> DataFrame:
    """symbol, time, signal: an hour that closes beyond the n hours before, where the hour before didn't close beyond its own."""
    w = beside()
    x = framed(numbered(hours, span=span), [{"_h": F.when(F.count("high").over(w.rowsBetween(-n, -1)) == n, F.max("high").over(w.rowsBetween(-n, -1))), "_l": F.when(F.count("low").over(w.rowsBetween(-n, -1)) == n, F.min("low").over(w.rowsBetween(-n, -1)))}, {"_up": F.lag(F.col("close") > F.col("_h")).over(w), "_down": F.lag(F.col("close") < F.col("_l")).over(w)}], n + 1)
    signal = F.when((F.col("close") > F.col("_h")) & ~F.col("_up"), 1).when((F.col("close") < F.col("_l")) & ~F.col("_down"), -1)
    return x.select("symbol", "time", signal.alias("signal")).where("signal IS NOT NULL")
