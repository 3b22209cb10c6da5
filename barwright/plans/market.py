"""Queries on bars, levels, indicators, rules and races, with DuckDB's SQL. Numbers are rounded to six places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.functions import costs, numeric
from barwright.operators import barriers, bars, frames, gates, inference, levels, recurrences, rules
from barwright.shipping import ship
from barwright.sources.market import manifest, ticks

HOUR = 3600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the statements below begin with.
CTE = {
    "ticks": "SELECT event_type AS symbol, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, epoch_us(ts) AS micros, value AS price, CAST(1 AS BIGINT) AS volume FROM events",
    "hours": "SELECT symbol, CAST(floor(t / 3600) * 3600 AS BIGINT) AS time, arg_min(price, micros) AS open, max(price) AS high, min(price) AS low, arg_max(price, micros) AS close, CAST(sum(volume) AS BIGINT) AS tick_volume FROM ticks GROUP BY 1, 2",
    "days": "SELECT symbol, CAST(floor((time + 19800) / 86400) * 86400 - 19800 AS BIGINT) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, CAST(sum(tick_volume) AS BIGINT) AS tick_volume FROM hours GROUP BY 1, 2",
    "cal": "SELECT *, ((time + 19800) % 86400) / 3600.0 AS ist_hour, CAST(floor((time + 19800) / 86400) AS BIGINT) AS ist_day, CAST(floor((time + 19800) / 604800) AS BIGINT) AS ist_week, CASE WHEN ((time + 19800) % 86400) / 3600.0 >= 2.5 AND ((time + 19800) % 86400) / 3600.0 < 11.5 THEN 'ASIA' WHEN ((time + 19800) % 86400) / 3600.0 >= 11.5 AND ((time + 19800) % 86400) / 3600.0 < 15.5 THEN 'LONDON' WHEN ((time + 19800) % 86400) / 3600.0 >= 15.5 AND ((time + 19800) % 86400) / 3600.0 < 17.5 THEN 'OVERLAP' WHEN ((time + 19800) % 86400) / 3600.0 >= 17.5 AND ((time + 19800) % 86400) / 3600.0 < 21.5 THEN 'NY' ELSE 'LATE' END AS session FROM hours",
    "candles": "SELECT *, abs(close - open) AS body, greatest(high - low, 1e-9) AS range, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS true_range FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY time)",
}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(ticks(spark, sf_dir), HOUR)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; ratios that often end in a tie (volume-weighted prices, means over a power of two) to more places."""
    return df.select(*[F.round(c, 9 if c in ("vwap48", "drawn_mean") else places).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None, *uses: str):
    """Registers a query; sql is its last SELECT over the named common table expressions, its doubles rounded by r()."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            need = ["ticks", *uses] if uses else []
            heads = [f"{k} AS ({CTE[k]})" for k in dict.fromkeys(need)]
            body = sql.strip()
            SQL[name] = (f"WITH RECURSIVE {', '.join(heads)}" + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")) if heads else body
        return f

    return add


@query("bars_hourly", "SELECT symbol, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_volume FROM hours", "hours")
def _(spark, d):
    return hourly(spark, d)


@query("bars_quarter_hour", "SELECT symbol, CAST(floor(t / 900) * 900 AS BIGINT) AS time, round(arg_min(price, micros), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, micros), 6) AS close, CAST(sum(volume) AS BIGINT) AS tick_volume FROM ticks GROUP BY 1, 2", "hours")
def _(spark, d):
    return bars.resample(ticks(spark, d), 900)


@query("bars_ist_daily", "SELECT symbol, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_volume FROM days", "hours", "days")
def _(spark, d):
    return bars.coarser(hourly(spark, d), 86_400, 19_800)


@query("bar_gaps", """WITH g AS (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS nx FROM hours)
SELECT symbol, time AS after, nx - time AS seconds, CAST(floor((nx - time) / 3600) - 1 AS BIGINT) AS missing, (CAST(floor(time / 86400) AS BIGINT) + 3) % 7 >= 4 AS weekend FROM g WHERE nx - time > 3600""", "hours")  # fmt: skip
def _(spark, d):
    return bars.gaps(hourly(spark, d), HOUR)


@query("tick_dedupe", "SELECT symbol, CAST(floor(t / 60) AS BIGINT) AS minute, arg_min(event_id, micros) AS event_id FROM ticks GROUP BY 1, 2", "hours")
def _(spark, d):
    t = ticks(spark, d).withColumn("minute", F.floor(F.col("t") / 60).cast("long"))
    return bars.first_of(t, ["symbol", "minute"], ["micros", "event_id"]).select("symbol", "minute", "event_id")


@query("bar_manifest_counts", "SELECT symbol, count(*) AS bars, min(time) AS first, max(time) AS last, CAST(sum(CAST(CAST('0x' || sha256(concat_ws('|', time, " + ", ".join(f"CAST(round({c} * 1000000) AS BIGINT)" for c in ("open", "high", "low", "close")) + ", tick_volume))[1:12] AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM hours GROUP BY 1", "hours")
def _(spark, d):
    return manifest(hourly(spark, d))


@query("range_statistics", "SELECT symbol, round(avg(high - low), 6) AS mean, round(quantile_cont(high - low, 0.5), 6) AS p50, round(quantile_cont(high - low, 0.9), 6) AS p90, round(quantile_cont(high - low, 0.99), 6) AS p99, round(max(high - low), 6) AS most FROM hours GROUP BY 1", "hours")
def _(spark, d):
    r = F.col("high") - F.col("low")
    p = F.percentile(r, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return hourly(spark, d).groupBy("symbol").agg(F.avg(r).alias("mean"), p.alias("p"), F.max(r).alias("most")).select("symbol", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "most")


@query("candle_parts", "SELECT symbol, time, round(body, 6) AS body, round(range, 6) AS range, round(upper_wick, 6) AS upper_wick, round(lower_wick, 6) AS lower_wick, round(true_range, 6) AS true_range FROM candles", "hours", "candles")
def _(spark, d):
    return frames.candle_parts(hourly(spark, d)).select("symbol", "time", "body", "range", "upper_wick", "lower_wick", "true_range")


_FRAME = "ROWS BETWEEN {} PRECEDING AND {}"
_PART = "PARTITION BY symbol ORDER BY time"


def _full(f: str, c: str, n: int, current: bool = False) -> str:
    w = f"OVER ({_PART} " + (_FRAME.format(n - 1, "CURRENT ROW") if current else _FRAME.format(n, "1 PRECEDING")) + ")"
    return f"CASE WHEN count({c}) {w} = {n} THEN {f} {w} END"


_ROLL = {
    "hh20": _full("max(high)", "high", 20), "ll20": _full("min(low)", "low", 20), "mean40": _full("avg(close)", "close", 40), "sd40": _full("stddev_pop(close)", "close", 40), "bb_mid": _full("avg(close)", "close", 20, True),
    "bb_up": f"{_full('avg(close)', 'close', 20, True)} + 2 * {_full('stddev_pop(close)', 'close', 20, True)}", "bb_low": f"{_full('avg(close)', 'close', 20, True)} - 2 * {_full('stddev_pop(close)', 'close', 20, True)}",
    "er20": f"CASE WHEN {_full('sum(step)', 'step', 20, True)} = 0 THEN 0.0 ELSE abs(close - lag(close, 20) OVER ({_PART})) / {_full('sum(step)', 'step', 20, True)} END",
    "vwap48": f"{_full('sum(close * tick_volume)', 'close', 48)} / {_full('sum(tick_volume)', 'tick_volume', 48)}",
}


@query("rolling_features", f"WITH s AS (SELECT *, abs(close - lag(close) OVER ({_PART})) AS step FROM hours) SELECT symbol, time, {', '.join(f'round({v}, {9 if k == "vwap48" else 6}) AS {k}' for k, v in _ROLL.items())} FROM s", "hours")
def _(spark, d):
    return frames.rolling_features(hourly(spark, d)).select("symbol", "time", *_ROLL)


@query("range_share_below", f"WITH s AS (SELECT symbol, time, high - low AS width, list(high - low) OVER ({_PART} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS held FROM hours) SELECT symbol, time, round(CASE WHEN len(held) = 100 THEN len(list_filter(held, lambda x: x < width)) / 100.0 END, 6) AS width_share FROM s", "hours")
def _(spark, d):
    return frames.share_below(hourly(spark, d).withColumn("width", F.col("high") - F.col("low")), "width", 100).select("symbol", "time", "width_share")


@query("round_levels", "SELECT symbol, time, round_even(close / 5, 0) * 5 AS level, round(close - round_even(close / 5, 0) * 5, 6) AS away FROM hours", "hours")
def _(spark, d):
    level = numeric.round_level(F.col("close"), 5.0)
    return hourly(spark, d).select("symbol", "time", level.alias("level"), (F.col("close") - level).alias("away"))


@query("session_labels", """SELECT symbol, time, round(ist_hour, 6) AS ist_hour, ist_day, ist_week, session, CASE WHEN ist_hour >= 11.5 AND ist_hour < 15.5 THEN 'LONDON_OPEN' WHEN ist_hour >= 17.5 AND ist_hour < 21.5 THEN 'NY_MORNING' WHEN ist_hour >= 15.5 AND ist_hour < 19.5 THEN 'LONDON_NY_OVERLAP' ELSE 'ASIA_OVERNIGHT' END AS risk_session,
CASE WHEN ist_hour >= 11.5 AND ist_hour < 21.5 THEN 1.5 ELSE 2.0 END AS stop_multiplier, (ist_hour >= 21.5 OR ist_hour < 2.5) AS late, (ist_hour >= 21.5 OR ist_hour < 11.5) AS overnight FROM cal""", "hours", "cal")  # fmt: skip
def _(spark, d):
    h = F.col("ist_hour")
    x = levels.with_calendar(hourly(spark, d))
    return x.select("symbol", "time", "ist_hour", "ist_day", "ist_week", "session", cal.risk_session_of(h).alias("risk_session"), cal.stop_multiplier(h).alias("stop_multiplier"), cal.in_session(h, 21.5, 26.5).alias("late"), cal.in_session(h, 21.5, 11.5).alias("overnight"))


@query("entry_gates", """WITH g AS (SELECT symbol, time, ist_hour, (ist_day + 3) % 7 AS wd, CAST(floor(time % 86400 / 60) AS BIGINT) AS mi FROM cal)
SELECT symbol, time, CASE WHEN wd >= 5 OR (wd = 0 AND ist_hour < 3.5) THEN 'weekend' WHEN NOT (ist_hour >= 6.0 AND ist_hour < 21.5) THEN 'window' WHEN wd = 4 AND ist_hour >= 21.0 THEN 'friday' WHEN least(mi, 1440 - mi) <= 10 THEN 'rollover' END AS reason FROM g""", "hours", "cal")  # fmt: skip
def _(spark, d):
    return hourly(spark, d).select("symbol", "time", cal.entry_block(F.col("time")).alias("reason"))


for _name, _period in (("previous_day_levels", "ist_day"), ("previous_week_levels", "ist_week")):

    @query(_name, f"""WITH p AS (SELECT symbol, {_period}, arg_min(open, time) AS o, max(high) AS h, min(low) AS l, arg_max(close, time) AS c FROM cal GROUP BY 1, 2),
q AS (SELECT symbol, {_period}, o, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM p WINDOW w AS (PARTITION BY symbol ORDER BY {_period}))
SELECT symbol, time, round(q.o, 6) AS p_open, round(q.h, 6) AS p_prev_high, round(q.l, 6) AS p_prev_low, round(q.c, 6) AS p_prev_close FROM cal JOIN q USING (symbol, {_period})""", "hours", "cal")  # fmt: skip
    def _(spark, d, period=_period):
        return levels.previous(levels.with_calendar(hourly(spark, d)), period, "p").select("symbol", "time", "p_open", "p_prev_high", "p_prev_low", "p_prev_close")


_ASIA = "CASE WHEN ist_hour >= 2.5 AND ist_hour < 11.5 THEN ist_day END AS occ"


@query("session_running", f"""WITH o AS (SELECT *, {_ASIA} FROM cal) SELECT symbol, time, round(max(high) OVER w, 6) AS run_high, round(min(low) OVER w, 6) AS run_low, round(first_value(open) OVER w, 6) AS run_open, count(*) OVER w AS run_bars FROM o WHERE occ IS NOT NULL WINDOW w AS (PARTITION BY symbol, occ ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "hours", "cal")
def _(spark, d):
    return levels.session_running(levels.with_calendar(hourly(spark, d)), 2.5, 11.5).where("occurrence IS NOT NULL").select("symbol", "time", "run_high", "run_low", "run_open", "run_bars")


@query("opening_range", f"""WITH o AS (SELECT *, {_ASIA} FROM cal), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, occ ORDER BY time) AS rn FROM o WHERE occ IS NOT NULL)
SELECT symbol, time, CASE WHEN rn >= 3 THEN round(max(CASE WHEN rn <= 3 THEN high END) OVER w, 6) END AS or_high, CASE WHEN rn >= 3 THEN round(min(CASE WHEN rn <= 3 THEN low END) OVER w, 6) END AS or_low FROM n WINDOW w AS (PARTITION BY symbol, occ ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "hours", "cal")  # fmt: skip
def _(spark, d):
    return levels.opening_range(levels.with_calendar(hourly(spark, d)), 2.5, 11.5, 3).where("occurrence IS NOT NULL").select("symbol", "time", "or_high", "or_low")


@query("last_session", f"""WITH o AS (SELECT *, {_ASIA} FROM cal), p AS (SELECT symbol, occ, max(time) AS ended, max(high) AS h, min(low) AS l, arg_min(open, time) AS op, arg_max(close, time) AS c FROM o WHERE occ IS NOT NULL GROUP BY 1, 2),
m AS (SELECT o.symbol, o.time, (SELECT max(p.occ) FROM p WHERE p.symbol = o.symbol AND p.ended < o.time AND (o.occ IS NULL OR p.occ < o.occ)) AS k FROM o)
SELECT m.symbol, m.time, round(h, 6) AS last_high, round(l, 6) AS last_low, round(op, 6) AS last_open, round(c, 6) AS last_close FROM m LEFT JOIN p ON p.symbol = m.symbol AND p.occ = m.k""", "hours", "cal")  # fmt: skip
def _(spark, d):
    return levels.last_session(levels.with_calendar(hourly(spark, d)), 2.5, 11.5).select("symbol", "time", "last_high", "last_low", "last_open", "last_close")


@query("trailing_day_range", """WITH p AS (SELECT symbol, ist_day, max(high) - min(low) AS r FROM cal GROUP BY 1, 2)
SELECT symbol, ist_day, round(CASE WHEN count(r) OVER w = 14 THEN avg(r) OVER w END, 6) AS day_range FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ist_day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""", "hours", "cal")  # fmt: skip
def _(spark, d):
    return levels.trailing_day_range(levels.with_calendar(hourly(spark, d))).select("symbol", "ist_day", "day_range").distinct()


@query("slot_norm", """SELECT symbol, time, round(CASE WHEN count(true_range) OVER w >= 10 THEN avg(true_range) OVER w END, 6) AS slot_norm FROM candles WINDOW w AS (PARTITION BY symbol, time % 86400 ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", "hours", "candles")
def _(spark, d):
    return levels.slot_norm(frames.candle_parts(hourly(spark, d))).select("symbol", "time", "slot_norm")


@query("session_vwap", f"""WITH o AS (SELECT *, {_ASIA} FROM cal) SELECT symbol, time, round(sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w, 6) AS session_vwap FROM o WHERE occ IS NOT NULL WINDOW w AS (PARTITION BY symbol, occ ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "hours", "cal")
def _(spark, d):
    return levels.session_vwap(levels.with_calendar(hourly(spark, d)), 2.5, 11.5).where("occurrence IS NOT NULL").select("symbol", "time", "session_vwap")


@query("once_per_session", f"""WITH o AS (SELECT *, {_ASIA}, {_full('max(high)', 'high', 20)} AS hh FROM cal), s AS (SELECT * FROM o WHERE close > hh), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, occ ORDER BY time) AS rn FROM s)
SELECT symbol, time FROM n WHERE rn = 1 OR occ IS NULL""", "hours", "cal")  # fmt: skip
def _(spark, d):
    x = frames.rolling_features(levels.with_calendar(hourly(spark, d)))
    s = x.withColumn("signal", numeric.signal(F.col("close") > F.col("hh20"), F.lit(False)))
    return levels.once_per(s, 2.5, 11.5).select("symbol", "time")


@query("minutes_in_hours", """SELECT h.symbol, h.time, count(*) AS ticks, round(max(t.price), 6) AS most FROM hours h JOIN ticks t ON t.symbol = h.symbol AND t.t >= h.time AND t.t < h.time + 3600 GROUP BY 1, 2""", "hours")
def _(spark, d):
    t = ticks(spark, d).withColumn("time", (F.floor(F.col("t") / HOUR) * HOUR).cast("long"))
    return hourly(spark, d).select("symbol", "time").join(t.select("symbol", "time", "price"), ["symbol", "time"]).groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("ticks"), F.max("price").alias("most"))


@query("event_blackout", """SELECT t.symbol, t.event_id FROM ticks t WHERE t.symbol <> 'error' AND EXISTS (SELECT 1 FROM ticks e WHERE e.symbol = 'error' AND e.price > 100 AND abs(e.t - t.t) <= 900)""", "hours")
def _(spark, d):
    t = ticks(spark, d)
    events = t.where("symbol = 'error' AND price > 100").select(F.col("t").alias("event_time"))
    return bars.within(t.where("symbol <> 'error'"), events, 900, time="t").select("symbol", "event_id")


# Averages that depend on all rows before, checked by recursion over row numbers.
def _recursive(name: str, value: str, p: int, k: float, source: str) -> str:
    return f"""{name}_n AS (SELECT symbol, time, {value} AS x, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM {source} WHERE {value} IS NOT NULL),
{name}_seed AS (SELECT symbol, avg(x) AS y FROM {name}_n WHERE rn <= {p} GROUP BY symbol HAVING count(*) = {p}),
{name}_r AS (SELECT n.symbol, n.time, n.rn, s.y FROM {name}_n n JOIN {name}_seed s ON s.symbol = n.symbol WHERE n.rn = {p} UNION ALL SELECT n.symbol, n.time, n.rn, r.y + {k!r} * (n.x - r.y) FROM {name}_r r JOIN {name}_n n ON n.symbol = r.symbol AND n.rn = r.rn + 1)"""


_D1 = _recursive("d10", "close", 10, 2 / 11, "days")


@query("daily_bias_as_of", f"""WITH {_D1}, x AS (SELECT days.symbol, days.time AS dt, days.time + 86400 AS closed, close AS dc, CASE WHEN close > y THEN 1 WHEN close < y THEN -1 WHEN y IS NOT NULL THEN 0 END AS bias FROM days LEFT JOIN d10_r ON d10_r.symbol = days.symbol AND d10_r.time = days.time)
SELECT h.symbol, h.time, x.dt AS day_time, round(x.dc, 6) AS day_close, CASE x.bias WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'even' END AS bias FROM hours h ASOF JOIN x ON h.symbol = x.symbol AND h.time >= x.closed""", "hours", "days")  # fmt: skip
def _(spark, d):
    h = hourly(spark, d)
    named = F.when(F.col("bias") == 1, "up").when(F.col("bias") == -1, "down").when(F.col("bias") == 0, "even")
    return gates.daily_bias(h, bars.coarser(h, 86_400, 19_800), 10).select("symbol", "time", "day_time", "day_close", named.alias("bias")).where("day_time IS NOT NULL")


_MOVES = f"mv AS (SELECT *, close - lag(close) OVER ({_PART}) AS d, high - lag(high) OVER ({_PART}) AS u, lag(low) OVER ({_PART}) - low AS v FROM candles), mm AS (SELECT *, greatest(d, 0.0) AS g0, greatest(-d, 0.0) AS l0, CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END AS pl, CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END AS mi FROM mv), gl AS (SELECT * REPLACE (CASE WHEN d IS NOT NULL THEN g0 END AS g0, CASE WHEN d IS NOT NULL THEN l0 END AS l0) FROM mm)"
_AVGS = [("atr14", "true_range", 14, 1 / 14, "gl"), ("ema20", "close", 20, 2 / 21, "gl"), ("ema50", "close", 50, 2 / 51, "gl"), ("ema200", "close", 200, 2 / 201, "gl"), ("fast", "close", 12, 2 / 13, "gl"), ("slow", "close", 26, 2 / 27, "gl"), ("up", "g0", 14, 1 / 14, "gl"), ("dn", "l0", 14, 1 / 14, "gl"), ("pdm", "pl", 14, 1 / 14, "gl"), ("mdm", "mi", 14, 1 / 14, "gl")]
_FIRST = ", ".join(_recursive(*a) for a in _AVGS)
_JOINED = "j1 AS (SELECT gl.*, " + ", ".join(f"{a[0]}_r.y AS {a[0]}" for a in _AVGS) + " FROM gl " + " ".join(f"LEFT JOIN {a[0]}_r ON {a[0]}_r.symbol = gl.symbol AND {a[0]}_r.time = gl.time" for a in _AVGS) + "), j2 AS (SELECT *, CASE WHEN dn IS NULL THEN NULL WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi14, fast - slow AS macd, CASE WHEN pdm + mdm > 0 THEN 100 * abs(pdm - mdm) / (pdm + mdm) ELSE 0.0 END AS dx FROM j1)"
_SECOND = _recursive("sig", "macd", 9, 0.2, "j2") + ", " + _recursive("adx", "dx", 14, 1 / 14, "j2")
_ALL = f"{_MOVES}, {_FIRST}, {_JOINED}, {_SECOND}, ind AS (SELECT j2.*, sig_r.y AS macd_signal, adx_r.y AS adx14, j2.macd - sig_r.y AS macd_hist FROM j2 LEFT JOIN sig_r ON sig_r.symbol = j2.symbol AND sig_r.time = j2.time LEFT JOIN adx_r ON adx_r.symbol = j2.symbol AND adx_r.time = j2.time)"
_IND = ["atr14", "ema20", "ema50", "ema200", "rsi14", "macd", "macd_signal", "macd_hist", "adx14"]


@query("indicators", f"WITH {_ALL} SELECT symbol, time, {', '.join(f'round({c}, 6) AS {c}' for c in _IND)} FROM ind", "hours", "candles")
def _(spark, d):
    return recurrences.indicators(frames.candle_parts(hourly(spark, d)), 5 * 86_400).select("symbol", "time", *_IND)


_CH = [(k, n) for k in ("hh", "ll") for n in (4, 10, 12, 24, 32, 96)]
_FEAT = f"""{_ALL}, st AS (SELECT *, abs(close - lag(close) OVER ({_PART})) AS step FROM ind),
f1 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _ROLL.items())}, {', '.join(f"{_full('max(high)' if k == 'hh' else 'min(low)', 'high' if k == 'hh' else 'low', n)} AS {k}{n}" for k, n in _CH)}, {_full('avg(atr14)', 'atr14', 20)} AS atr_mean20, {_full('avg(atr14)', 'atr14', 50)} AS atr_mean50, {_full('min(range)', 'range', 7)} AS min7, {_full('avg(close)', 'close', 20)} AS mean20, {_full('stddev_pop(close)', 'close', 20)} AS sd20 FROM st),
f2 AS (SELECT *, mean20 + 2 * sd20 AS up20, mean20 - 2 * sd20 AS lo20, mean20 + 2 * sd20 < mean20 + 1.5 * atr14 AND mean20 - 2 * sd20 > mean20 - 1.5 * atr14 AS squeeze FROM f1),
feat AS (SELECT *, lag(open) OVER w AS open_1, lag(high) OVER w AS high_1, lag(low) OVER w AS low_1, lag(close) OVER w AS close_1, lag(high, 2) OVER w AS high_2, lag(low, 2) OVER w AS low_2, lag(close, 8) OVER w AS close_8, lag(close, 12) OVER w AS close_12, lag(range) OVER w AS range_1, lag(hh20) OVER w AS hh20_1, lag(ll20) OVER w AS ll20_1, lag(hh10, 10) OVER w AS hh10_10, lag(ll10, 10) OVER w AS ll10_10, lag(rsi14) OVER w AS rsi_1, lag(min7) OVER w AS range_min7_1, lag(squeeze) OVER w AS squeeze_1 FROM f2 WINDOW w AS (PARTITION BY symbol ORDER BY time))"""
#: The rules' conditions for long and short, written out from their definitions and not from operators.rules.
_RULES = """ema_stack|trend|ema20 > ema50 AND ema50 > ema200 AND close > ema20|ema20 < ema50 AND ema50 < ema200 AND close < ema20
donchian_break|trend|close > hh20|close < ll20
donchian_break_adx|trend|close > hh20 AND adx14 > 25|close < ll20 AND adx14 > 25
pullback_ema20|trend|ema50 > ema200 AND low_1 <= ema20 AND close > ema20|ema50 < ema200 AND high_1 >= ema20 AND close < ema20
momentum_roc|trend|(close - close_12) / nullif(atr14, 0) > 1|(close - close_12) / nullif(atr14, 0) < -1
higher_high_structure|trend|hh10 > hh10_10 AND ll10 > ll10_10 AND close > ema20|hh10 < hh10_10 AND ll10 < ll10_10 AND close < ema20
zscore_revert|reversion|(close - mean40) / nullif(sd40, 0) < -2|(close - mean40) / nullif(sd40, 0) > 2
bb_fade|reversion|low < lo20 AND close > lo20|high > up20 AND close < up20
rsi_extreme|reversion|rsi_1 < 25 AND rsi14 >= 25|rsi_1 > 75 AND rsi14 <= 75
atr_exhaustion|reversion|(close - close_8) / nullif(atr14, 0) < -2.5|(close - close_8) / nullif(atr14, 0) > 2.5
range_rejection|reversion|low <= ll24 AND lower_wick / range > 0.5|high >= hh24 AND upper_wick / range > 0.5
failed_breakout|reversion|low < ll20 AND close > ll20 AND close > open|high > hh20 AND close < hh20 AND close < open
vwap_revert|reversion|(close - vwap48) / nullif(atr14, 0) < -1.5|(close - vwap48) / nullif(atr14, 0) > 1.5
squeeze_break|volatility|squeeze_1 AND close > up20|squeeze_1 AND close < lo20
atr_expansion|volatility|atr14 > 1.5 * atr_mean20 AND close > open|atr14 > 1.5 * atr_mean20 AND close < open
nr7_break|volatility|range_1 <= range_min7_1 AND close > high_1|range_1 <= range_min7_1 AND close < low_1
low_vol_revert|volatility|atr14 < 0.7 * atr_mean50 AND (close - mean20) / nullif(sd20, 0) < -1.5|atr14 < 0.7 * atr_mean50 AND (close - mean20) / nullif(sd20, 0) > 1.5
opening_break|session|close > hh4|close < ll4
session_sweep_revert|session|low < ll32 AND close > ll32|high > hh32 AND close < hh32
prev_day_level|session|low <= ll96 AND close > ll96|high >= hh96 AND close < hh96
displacement|structure|abs(close - open) > 1.5 * atr14 AND close > open|abs(close - open) > 1.5 * atr14 AND close < open
fair_value_gap|structure|low > high_2|high < low_2
fair_value_gap_macd|structure|low > high_2 AND macd > macd_signal|high < low_2 AND macd < macd_signal
liquidity_sweep|structure|low < ll12 AND close > ll12 AND lower_wick / range > 0.4|high > hh12 AND close < hh12 AND upper_wick / range > 0.4
break_retest|structure|close_1 > hh20_1 AND low <= hh20_1 AND close > hh20_1|close_1 < ll20_1 AND high >= ll20_1 AND close < ll20_1
engulfing|structure|close > open AND close_1 < open_1 AND close > open_1 AND open < close_1|close < open AND close_1 > open_1 AND close < open_1 AND open > close_1
inside_bar_break|structure|high_1 < high_2 AND low_1 > low_2 AND close > high_1|high_1 < high_2 AND low_1 > low_2 AND close < low_1"""
_COND = [line.split("|") for line in _RULES.split("\n")]
_SIGS = "sigs AS (" + " UNION ALL ".join(f"SELECT symbol, time, '{n}' AS rule, '{f}' AS family, CASE WHEN {short} THEN -1 WHEN {long} THEN 1 ELSE 0 END AS signal FROM feat" for n, f, long, short in _COND) + ")"


@query("rule_signals", f"WITH {_FEAT}, {_SIGS} SELECT symbol, time, rule, family, CAST(signal AS BIGINT) AS signal FROM sigs WHERE signal <> 0", "hours", "candles")
def _(spark, d):
    return rules.signals(rules.features(hourly(spark, d)))


@query("rule_library", f"WITH {_FEAT}, {_SIGS} SELECT family, count(DISTINCT rule) AS rules, count(*) AS signals, count(*) FILTER (signal > 0) AS longs, count(DISTINCT symbol) AS symbols FROM sigs WHERE signal <> 0 GROUP BY ROLLUP (family)", "hours", "candles")
def _(spark, d):
    return rules.library_summary(rules.signals(rules.features(hourly(spark, d))))


_NUM = f"WITH {_ALL}, nb AS (SELECT *, row_number() OVER ({_PART}) AS rn, lead(open) OVER ({_PART}) AS entry FROM ind)"
_E = "en AS (SELECT symbol, rn, entry, atr14, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM nb WHERE entry IS NOT NULL AND atr14 > 0)"
_RACE = """ra AS (SELECT e.symbol, e.rn, e.side, any_value(e.entry) AS entry, any_value(e.atr14) AS atr14, min(CASE WHEN (e.side > 0 AND b.low <= e.entry - 1.5 * e.atr14) OR (e.side < 0 AND b.high >= e.entry + 1.5 * e.atr14) THEN b.rn END) AS s, min(CASE WHEN (e.side > 0 AND b.high >= e.entry + 3.0 * e.atr14) OR (e.side < 0 AND b.low <= e.entry - 3.0 * e.atr14) THEN b.rn END) AS t, max(b.rn) AS last
FROM en e JOIN nb b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + 24 GROUP BY 1, 2, 3), oc AS (SELECT *, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN -1 WHEN t IS NOT NULL THEN 1 ELSE 0 END AS outcome FROM ra)"""


def _raced(spark, d):
    x = barriers.numbered(recurrences.indicators(frames.candle_parts(hourly(spark, d)), 5 * 86_400))
    s = x.select("symbol", "time", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("signal"))
    e = barriers.entries_of(x, s)
    return x, barriers.race(x, e, F.col("entry") + F.col("side") * 3.0 * F.col("atr14"), F.col("entry") - F.col("side") * 1.5 * F.col("atr14"), 24)


@query("barrier_race", f"{_NUM}, {_E}, {_RACE} SELECT symbol, rn, CAST(side AS BIGINT) AS side, CAST(outcome AS BIGINT) AS outcome, CASE WHEN outcome = -1 THEN s WHEN outcome = 1 THEN t ELSE last END AS exit_rn FROM oc", "hours", "candles")
def _(spark, d):
    return _raced(spark, d)[1].select("symbol", "rn", "side", "outcome", "exit_rn")


@query("excursion_baseline", f"""{_NUM}, ex AS (SELECT symbol, entry, atr14, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS n FROM nb WINDOW w AS ({_PART} ROWS BETWEEN 1 FOLLOWING AND 32 FOLLOWING)), v AS (SELECT symbol, (hi - entry) / atr14 AS mfe, (entry - lo) / atr14 AS mae FROM ex WHERE n = 32 AND atr14 > 0)
SELECT symbol, count(*) AS n, round(avg(mfe), 6) AS mfe, round(quantile_cont(mfe, 0.5), 6) AS mfe_median, round(avg(mae), 6) AS mae, round(quantile_cont(mae, 0.5), 6) AS mae_median FROM v GROUP BY 1""", "hours", "candles")  # fmt: skip
def _(spark, d):
    return barriers.excursions(recurrences.indicators(frames.candle_parts(hourly(spark, d)), 5 * 86_400), 32)


_LAGS = [1, 2, 4, 8, 16, 32]


@query("return_autocorrelation", f"WITH r AS (SELECT symbol, time, ln(close / lag(close) OVER ({_PART})) AS r FROM hours), l AS (SELECT *, {', '.join(f'lag(r, {k}) OVER ({_PART}) AS r{k}' for k in _LAGS)} FROM r), c AS (SELECT symbol, {', '.join(f'round(corr(r, r{k}), 6) AS lag_{k}' for k in _LAGS)} FROM l GROUP BY 1) UNPIVOT c ON {', '.join(f'lag_{k}' for k in _LAGS)} INTO NAME lag VALUE correlation", "hours")
def _(spark, d):
    return barriers.autocorrelation(hourly(spark, d), _LAGS)


@query("session_buckets", f"WITH x AS (SELECT session, abs(ln(close / lag(close) OVER ({_PART}))) * 1e4 AS r, high - low AS w FROM cal) SELECT session, count(*) AS bars, round(avg(r), 6) AS mean_move_bp, round(avg(w), 6) AS mean_range FROM x WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 30", "hours", "cal")
def _(spark, d):
    x = levels.with_calendar(hourly(spark, d)).withColumn("r", F.abs(F.log(F.col("close") / F.lag("close").over(frames.series()))) * 1e4)
    g = x.where("r IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("bars"), F.avg("r").alias("mean_move_bp"), F.avg(F.col("high") - F.col("low")).alias("mean_range"))
    return g.where("bars >= 30")


@query("information_coefficient", f"""WITH x AS (SELECT symbol, time, (close - open) AS f, lead(close, 4) OVER ({_PART}) / close - 1 AS y FROM hours), v AS (SELECT *, row_number() OVER ({_PART}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM x WHERE y IS NOT NULL),
e AS (SELECT symbol, corr(f, y) AS ic, count(*) AS rows FROM v GROUP BY 1), c AS (SELECT symbol, i // 30 AS g, corr(f, y) AS ic FROM v WHERE (i // 30) * 30 < n - 30 GROUP BY 1, 2), r AS (SELECT symbol, count(ic) AS k, avg(ic) AS m, stddev_pop(ic) AS s FROM c GROUP BY 1)
SELECT symbol, round(e.ic, 6) AS ic, e.rows, coalesce(k, 0) AS windows, round(CASE WHEN k >= 2 AND e.rows >= 60 AND s > 0 THEN m / s ELSE 0.0 END, 6) AS icir FROM e LEFT JOIN r USING (symbol)""", "hours")  # fmt: skip
def _(spark, d):
    return inference.information(hourly(spark, d).withColumn("f", F.col("close") - F.col("open")), "f", 4, 30)


@query("holding_costs", """WITH x AS (SELECT event_id, event_id % 2 = 0 AS b, t AS a, lead(t) OVER (PARTITION BY symbol ORDER BY micros) AS z FROM ticks), y AS (SELECT event_id, b, CASE WHEN z > a THEN CAST(floor(z / 86400) - floor(a / 86400) AS BIGINT) ELSE 0 END AS nights, CASE WHEN z > a THEN (SELECT count(*) FROM range(CAST(floor(a / 86400) AS BIGINT) + 1, CAST(floor(z / 86400) AS BIGINT) + 1) r(d) WHERE (d + 3) % 7 = 2) * 2 ELSE 0 END AS extra FROM x WHERE z IS NOT NULL)
SELECT event_id, nights, CAST(nights + extra AS BIGINT) AS units, round(CASE WHEN b THEN -515.5 ELSE 0.0 END * 0.001 * 100 * 0.01 * (nights + extra), 6) AS swap FROM y""", "hours")  # fmt: skip
def _(spark, d):
    from pyspark.sql import Window

    t = ticks(spark, d).withColumn("z", F.lead("t").over(Window.partitionBy("symbol").orderBy("micros", "event_id"))).where("z IS NOT NULL")
    units = costs.swap_units(F.col("t"), F.col("z"))
    return t.select("event_id", costs.nights(F.col("t"), F.col("z")).cast("long").alias("nights"), units.cast("long").alias("units"), costs.swap(F.lit(0.01), F.col("event_id") % 2 == 0, units).alias("swap"))


@query("sizing_ladders", """SELECT event_id, CASE WHEN b < 200 THEN 0.01 WHEN b < 400 THEN 0.01 WHEN b < 800 THEN 0.01 ELSE 0.02 END AS risk_lots, CAST(CASE WHEN b < 200 THEN 1 WHEN b < 400 THEN 2 ELSE 3 END AS BIGINT) AS risk_positions, CASE WHEN b < 50 THEN NULL WHEN b < 800 THEN 0.01 ELSE 0.02 END AS lots,
CAST(CASE WHEN b < 50 THEN 0 WHEN b < 100 THEN 1 WHEN b < 400 THEN 2 WHEN b < 800 THEN 3 WHEN b < 1200 THEN 2 ELSE 3 END AS BIGINT) AS positions FROM (SELECT event_id, price * 10 AS b FROM ticks)""", "hours")  # fmt: skip
def _(spark, d):
    b = F.col("price") * 10
    return ticks(spark, d).select("event_id", costs.risk_ladder(b, 1).alias("risk_lots"), costs.risk_ladder(b, 3).alias("risk_positions"), costs.size_ladder(b, 1).alias("lots"), F.coalesce(costs.size_ladder(b, 2), F.lit(0)).alias("positions"))
