"""Signals of the strategies on quarter hours, with SQL of their own."""

from __future__ import annotations

from barwright.operators import bars as b
from barwright.operators import strategies
from barwright.plans.market import _ALL, _PART, CTE, _recursive, hourly, query
from barwright.plans.series import _QQE, _SUPER
from barwright.sources.market import ticks

SPAN = 5 * 86_400
_QUARTERS = CTE["hours"].replace("/ 3600) * 3600", "/ 900) * 900")
_H = "((time + 19800) % 86400) / 3600.0"
_BASE = f"""hours AS ({_QUARTERS}), candles AS ({CTE["candles"]}), {_ALL}, {_recursive("e13", "close", 13, 2 / 14, "ind")}, {_recursive("e34", "close", 34, 2 / 35, "ind")}, {_SUPER}, {_QQE[_QQE.index("q0 AS"):]},
ud AS (SELECT symbol, time // 86400 AS d, arg_min(open, time) AS uo, min(time % 86400) AS uf, max(high) AS h, min(low) AS l, max(high) FILTER (time % 86400 < 28800) AS mh, min(low) FILTER (time % 86400 < 28800) AS ml FROM hours GROUP BY 1, 2),
ue AS (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY d) AS yh, lag(l) OVER (PARTITION BY symbol ORDER BY d) AS yl FROM ud),
ad AS (SELECT symbol, CAST(floor((time + 19800) / 86400) AS BIGINT) AS d, max(high) AS ah, min(low) AS al, count(*) AS an FROM hours WHERE {_H} >= 2.5 AND {_H} < 11.5 GROUP BY 1, 2),
pd AS (SELECT symbol, CAST(floor((time + 19800) / 86400) AS BIGINT) + 1 AS d, max(high) AS dh, min(low) AS dl, count(*) AS dcount FROM hours GROUP BY 1, 2),
s0 AS (SELECT i.*, e13_r.y AS e13, e34_r.y AS e34, st.dir, q5.trend AS mom, st.bn, ((i.time + 19800) % 86400) / 3600.0 AS hr, CAST(floor((i.time + 19800) / 86400) AS BIGINT) AS idy, i.time // 86400 AS udy
FROM ind i LEFT JOIN e13_r ON e13_r.symbol = i.symbol AND e13_r.time = i.time LEFT JOIN e34_r ON e34_r.symbol = i.symbol AND e34_r.time = i.time JOIN st ON st.symbol = i.symbol AND st.time = i.time JOIN q5 ON q5.symbol = i.symbol AND q5.time = i.time),
s1 AS (SELECT s0.*, pd.dh, pd.dl, dcount, CASE WHEN hr >= 17.5 THEN avg(close) OVER ev END AS em, CASE WHEN hr >= 17.5 THEN stddev_pop(close) OVER ev END AS es, CASE WHEN hr >= 17.5 THEN count(*) OVER ev END AS en, uo, uf, yh, yl, ue.mh, ue.ml, CASE WHEN hr >= 11.5 THEN ah END AS ah, CASE WHEN hr >= 11.5 THEN al END AS al, CASE WHEN hr >= 11.5 THEN an END AS an,
CASE WHEN count(*) OVER n20 = 20 THEN avg(close) OVER n20 END AS m20, CASE WHEN count(*) OVER n20 = 20 THEN stddev_pop(close) OVER n20 END AS d20, CASE WHEN count(*) OVER n20 = 20 THEN avg(tick_volume) OVER n20 END AS v20, CASE WHEN count(atr14) OVER n99 = 100 THEN quantile_cont(atr14, 0.5) OVER n99 END AS med,
max(high) FILTER (hr >= 5.5 AND hr < 11.5) OVER r100 AS rh, min(low) FILTER (hr >= 5.5 AND hr < 11.5) OVER r100 AS rl, count(*) FILTER (hr >= 5.5 AND hr < 11.5) OVER r100 AS rb, {", ".join(f"lag({c}, {n}) OVER w AS {c}_{n}" for c, ns in {"close": (1, 2, 3, 5, 20), "open": (1, 2, 3), "low": (1,), "high": (1,), "time": (3, 4), "atr14": (1, 4), "e13": (1,), "e34": (1,), "ema20": (1,), "macd": (1,), "macd_signal": (1,), "dir": (1,), "mom": (1,)}.items() for n in ns)}
FROM s0 JOIN ue ON ue.symbol = s0.symbol AND ue.d = s0.udy LEFT JOIN ad ON ad.symbol = s0.symbol AND ad.d = s0.idy LEFT JOIN pd ON pd.symbol = s0.symbol AND pd.d = s0.idy
WINDOW ev AS (PARTITION BY s0.symbol, idy, hr >= 17.5 ORDER BY bn ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY s0.symbol ORDER BY bn), n20 AS (PARTITION BY s0.symbol ORDER BY bn ROWS 19 PRECEDING), n99 AS (PARTITION BY s0.symbol ORDER BY bn ROWS 99 PRECEDING), r100 AS (PARTITION BY s0.symbol ORDER BY bn ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"""
_DRIVE = "hr = 13.25 AND time - time_3 = 2700 AND time_3 - time_4 <= 3600 AND atr14_4 > 0"
_COUNT = " + ".join("CASE WHEN {a} {{c}} {b} THEN 1 ELSE 0 END".format(a=a, b=o) for a, o in (("close", "open"), ("close_1", "open_1"), ("close_2", "open_2"), ("close_3", "open_3")))
#: Name, long, short, session, memory.
_RULES = f"""trend_pullback|e13_1 > e34_1 AND e13 > e34 AND low_1 <= e13_1 AND close > greatest(close_1, e13)|e13_1 < e34_1 AND e13 < e34 AND high_1 >= e13_1 AND close < least(close_1, e13)|hr >= 11.5 AND hr < 21.5|edge
band_reversion|close < m20 - 2 * d20 AND rsi14 < 35|close > m20 + 2 * d20 AND rsi14 > 65|hr >= 17.5 AND hr < 21.5|none
session_breakout|rb > 3 AND close > rh AND close_1 <= rh|rb > 3 AND close < rl AND close_1 >= rl|hr >= 11.5 AND hr < 13.5|edge
asia_volatile_break|an >= 16 AND atr14 > med AND close > ah|an >= 16 AND atr14 > med AND close < al|hr >= 11.5 AND hr < 23.5|ist
daily_open_momentum|uf <= 7200 AND close > uo + 0.8 * atr14 AND ema50 > ema200|uf <= 7200 AND close < uo - 0.8 * atr14 AND ema50 < ema200|hr >= 5.5 AND hr < 23.5|utc
open_drive|{_DRIVE} AND close >= open_3 + atr14_4 AND {_COUNT.format(c=">")} > 2|{_DRIVE} AND close <= open_3 - atr14_4 AND {_COUNT.format(c="<")} > 2|hr >= 12.5 AND hr < 13.5|none
range_fade|atr14 > 0 AND ema20 - close > atr14|atr14 > 0 AND close - ema20 > atr14|hr >= 2 AND hr < 9|none
overlap_momentum|close > greatest(close_20, close_5) AND close_20 IS NOT NULL AND open > close|close < least(close_20, close_5) AND close_20 IS NOT NULL AND open < close|hr >= 18 AND hr < 22|none
keltner_break|close_1 <= ema20_1 + 2 * atr14_1 AND close > ema20 + 2 * atr14|close_1 >= ema20_1 - 2 * atr14_1 AND close < ema20 - 2 * atr14|true|none
macd_cross|close > ema200 AND macd_1 <= macd_signal_1 AND macd > macd_signal|close < ema200 AND macd_1 >= macd_signal_1 AND macd < macd_signal|true|none
volume_pullback|tick_volume > v20 AND rsi14 >= 35 AND rsi14 <= 65 AND close > greatest(ema50, ema20) AND ema50 > ema200 AND low_1 <= ema20_1 * 1.001|tick_volume > v20 AND rsi14 >= 35 AND rsi14 <= 65 AND close < least(ema50, ema20) AND ema50 < ema200 AND high_1 >= ema20_1 * 0.999|hr >= 15.5 AND hr < 21.5|none
ribbon|close > ema20 AND ema20 > ema50 AND ema50 > ema200|close < ema20 AND ema20 < ema50 AND ema50 < ema200|true|none
ribbon_asia|close > ema20 AND ema20 > ema50 AND ema50 > ema200|close < ema20 AND ema20 < ema50 AND ema50 < ema200|hr >= 2.5 AND hr < 11.5|edge
previous_day_break|close_1 <= yh AND close > yh|close_1 >= yl AND close < yl|true|none
morning_range_break|time % 86400 >= 28800 AND time % 86400 < 36000 AND mh - ml <= 50 AND close_1 <= mh AND close > mh|time % 86400 >= 28800 AND time % 86400 < 36000 AND mh - ml <= 50 AND close_1 >= ml AND close < ml|true|none
trend_flip|dir_1 = -1 AND dir = 1 AND close > ema200|dir_1 = 1 AND dir = -1 AND close < ema200|true|none
momentum_flip|mom_1 = -1 AND mom = 1|mom_1 = 1 AND mom = -1|hr >= 11.5 AND hr < 15.5|none
asia_sweep|rb > 3 AND atr14 > 0 AND rh - rl >= 0.3 * atr14 AND low < rl AND close > rl|rb > 3 AND atr14 > 0 AND rh - rl >= 0.3 * atr14 AND high > rh AND close < rh|hr >= 11.5 AND hr < 15.5|none
session_mean|en > 3 AND es >= 0.5 AND close < em - 1.7 * es AND rsi14 < 35|en > 3 AND es >= 0.5 AND close > em + 1.7 * es AND rsi14 > 65|hr >= 17.5 AND hr < 21.5|none
day_raid|dcount > 3 AND atr14 > 0 AND NOT coalesce(abs(close - ema20) > 3 * atr14, false) AND low + 0.05 * atr14 < dl AND close > dl|dcount > 3 AND atr14 > 0 AND NOT coalesce(abs(close - ema20) > 3 * atr14, false) AND high - 0.05 * atr14 > dh AND close < dh|hr >= 11.5 AND hr < 21.5|none"""
_EACH = " UNION ALL ".join(f"SELECT symbol, time, bn, idy, udy, '{n}' AS strategy, '{m}' AS memory, {s} AS ins, CASE WHEN coalesce({long}, false) THEN 1 WHEN coalesce({short}, false) THEN -1 ELSE 0 END AS signal FROM s1" for n, long, short, s, m in (line.split("|") for line in _RULES.split("\n")))
_KEPT = f"""sg AS ({_EACH}), sr AS (SELECT *, lag(CASE WHEN ins THEN signal ELSE 0 END) OVER (PARTITION BY symbol, strategy ORDER BY bn) AS was FROM sg),
sf AS (SELECT *, count(*) OVER (PARTITION BY symbol, strategy, udy ORDER BY bn) AS nu, count(*) FILTER (ins) OVER (PARTITION BY symbol, strategy, idy ORDER BY bn) AS ni FROM sr WHERE signal <> 0)"""


@query("strategy_signals", f"WITH {_BASE}, {_KEPT} SELECT symbol, time, strategy, CAST(signal AS BIGINT) AS signal FROM sf WHERE ins AND CASE memory WHEN 'edge' THEN was IS DISTINCT FROM signal WHEN 'utc' THEN nu = 1 WHEN 'ist' THEN ni = 1 ELSE true END", "ticks")
def _(spark, d):
    return strategies.signals(b.resample(ticks(spark, d), 900), SPAN)


@query("hourly_channel", f"""WITH n AS (SELECT *, count(*) OVER w AS k, max(high) OVER w AS h, min(low) OVER w AS l FROM hours WINDOW w AS ({_PART} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)), c AS (SELECT *, CASE WHEN k = 100 THEN close > h END AS up, CASE WHEN k = 100 THEN close < l END AS dn FROM n), p AS (SELECT *, lag(up) OVER ({_PART}) AS up1, lag(dn) OVER ({_PART}) AS dn1 FROM c)
SELECT symbol, time, CAST(CASE WHEN up AND NOT up1 THEN 1 ELSE -1 END AS BIGINT) AS signal FROM p WHERE (up AND NOT up1) OR (dn AND NOT dn1)""", "hours")  # fmt: skip
def _(spark, d):
    return strategies.hourly_channel(hourly(spark, d), 100, SPAN)
