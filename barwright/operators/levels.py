"""Levels anchored in the calendar: days, weeks, sessions and opening ranges (IST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators.frames import series


def with_calendar(bars: DataFrame) -> DataFrame:
    t = F.col("time")
    bars = bars.withColumns({"ist_hour": cal.ist_hour(t), "ist_day": cal.ist_day(t).cast("long"), "ist_week": cal.ist_week(t).cast("long")})
    return bars.withColumn("session", cal.session_of(F.col("ist_hour")))


def _periods(bars: DataFrame, period: str) -> DataFrame:
    return bars.groupBy("symbol", period).agg(F.min_by("open", "time").alias("p_open"), F.max("high").alias("p_high"), F.min("low").alias("p_low"), F.max_by("close", "time").alias("p_close"))


def previous(bars: DataFrame, period: str, prefix: str) -> DataFrame:
    """High, low and close of the previous day or week with bars, and this one's open."""
    w = Window.partitionBy("symbol").orderBy(period)
    p = _periods(bars, period)
    p = p.select("symbol", period, F.col("p_open").alias(f"{prefix}_open"), *[F.lag(f"p_{k}").over(w).alias(f"{prefix}_prev_{k}") for k in ("high", "low", "close")])
    return bars.join(p, ["symbol", period])


def occurrences(bars: DataFrame, a: float, b: float, name: str = "occurrence") -> DataFrame:
    """A number for each occurrence of a session: the IST day on which it begins; null outside."""
    inside = cal.in_session(F.col("ist_hour"), a, b)
    wraps = b > 24 or b < a
    day = F.when(inside, F.col("ist_day") - (F.when(F.col("ist_hour") < a, 1).otherwise(0) if wraps else F.lit(0)))
    return bars.withColumn(name, day)


def session_running(bars: DataFrame, a: float, b: float) -> DataFrame:
    """Running high, low, open and number of bars within the session's occurrence, this bar included."""
    bars = occurrences(bars, a, b)
    w = Window.partitionBy("symbol", "occurrence").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("occurrence").isNotNull()
    return bars.withColumns({"run_high": F.when(inside, F.max("high").over(w)), "run_low": F.when(inside, F.min("low").over(w)), "run_open": F.when(inside, F.first("open").over(w)), "run_bars": F.when(inside, F.count(F.lit(1)).over(w))})


def opening_range(bars: DataFrame, a: float, b: float, k: int) -> DataFrame:
    """High and low of the first k bars of an occurrence, known from the k-th bar on."""
    bars = occurrences(bars, a, b)
    w = Window.partitionBy("symbol", "occurrence").orderBy("time")
    rn = F.row_number().over(w)
    bars = bars.withColumn("_rn", F.when(F.col("occurrence").isNotNull(), rn))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ready = F.col("_rn") >= k
    high, low = F.max(F.when(F.col("_rn") <= k, F.col("high"))).over(run), F.min(F.when(F.col("_rn") <= k, F.col("low"))).over(run)
    return bars.withColumns({"or_high": F.when(ready, high), "or_low": F.when(ready, low)}).drop("_rn")


def last_session(bars: DataFrame, a: float, b: float) -> DataFrame:
    """High, low, open and close of the most recent completed occurrence before each bar."""
    bars = occurrences(bars, a, b)
    p = _periods(bars.where("occurrence IS NOT NULL"), "occurrence")
    # an occurrence is complete for bars after its last one: for those of its day that come later and of later days
    marked = bars.withColumn("_last", F.max("occurrence").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("symbol").orderBy("occurrence")
    p = p.withColumns({f"q_{k}": F.lag(f"p_{k}").over(w) for k in ("high", "low", "open", "close")}).withColumnRenamed("occurrence", "_last")
    out = marked.join(p, ["symbol", "_last"], "left")
    inside = F.col("occurrence").isNotNull()
    return out.withColumns({f"last_{k}": F.when(inside, F.col(f"q_{k}")).otherwise(F.col(f"p_{k}")) for k in ("high", "low", "open", "close")}).drop("_last", *[f"{x}_{k}" for x in "pq" for k in ("high", "low", "open", "close")])


def trailing_day_range(bars: DataFrame, days: int = 14) -> DataFrame:
    """Mean range of the completed days before, null until there are that many."""
    w = Window.partitionBy("symbol").orderBy("ist_day").rowsBetween(-days, -1)
    p = _periods(bars, "ist_day").withColumn("_r", F.col("p_high") - F.col("p_low"))
    p = p.select("symbol", "ist_day", F.when(F.count("_r").over(w) == days, F.avg("_r").over(w)).alias("day_range"))
    return bars.join(p, ["symbol", "ist_day"])


def slot_norm(bars: DataFrame, c: str = "true_range", n: int = 20, least: int = 10) -> DataFrame:
    """Mean of c in the same slot of the day over its last n occurrences, this one excluded."""
    slot = F.pmod(F.col("time"), F.lit(cal.DAY))
    w = Window.partitionBy("symbol", slot).orderBy("time").rowsBetween(-n, -1)
    return bars.withColumn("slot_norm", F.when(F.count(c).over(w) >= least, F.avg(c).over(w)))


def session_vwap(bars: DataFrame, a: float, b: float) -> DataFrame:
    bars = occurrences(bars, a, b)
    w = Window.partitionBy("symbol", "occurrence").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    pv = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("tick_volume")
    return bars.withColumn("session_vwap", F.when(F.col("occurrence").isNotNull(), F.sum(pv).over(w) / F.sum("tick_volume").over(w)))


def once_per(signals: DataFrame, a: float, b: float) -> DataFrame:
    """The first signal of each occurrence; signals outside of the session stay."""
    s = occurrences(signals.where("signal <> 0"), a, b)
    w = Window.partitionBy("symbol", "occurrence").orderBy("time")
    return s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 OR occurrence IS NULL").drop("_rn")
