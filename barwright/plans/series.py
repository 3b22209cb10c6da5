"""Queries on liquidity, ratchets, long ranks, excursions and views of the past, with DuckDB's SQL written out from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators import excursions as ex
from barwright.operators import frames, liquidity, ranks, ratchets
from barwright.operators.blocks import numbered
from barwright.plans.market import _PART, CTE, _recursive, hourly, query
from barwright.sources.market import ticks

#: Seconds of a chunk of bars.
SPAN = 5 * 86_400

_NUM = f"sn AS (SELECT *, row_number() OVER ({_PART}) - 1 AS bn, lag(close) OVER ({_PART}) AS pc FROM hours)"
_LIQ = f"""{_NUM}, tr0 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS trv FROM sn), {_recursive("a10", "trv", 10, 0.1, "tr0")},
pv AS (SELECT a.symbol, a.bn, s.side, s.side * CASE WHEN s.side > 0 THEN a.high ELSE a.low END AS v FROM sn a, (VALUES (1), (-1)) s(side)
WHERE a.bn > 7 AND (SELECT count(*) FROM sn x WHERE x.symbol = a.symbol AND x.bn BETWEEN a.bn - 7 AND a.bn + 1 AND x.bn <> a.bn AND CASE WHEN s.side > 0 THEN x.high < a.high OR (x.bn > a.bn AND x.high = a.high) ELSE x.low > a.low OR (x.bn > a.bn AND x.low = a.low) END) = 8),
pk AS (SELECT p.*, row_number() OVER (PARTITION BY p.symbol, p.side ORDER BY p.bn) AS k FROM pv p),
pb AS (SELECT pk.*, y / {liquidity.MARGIN!r} AS band FROM pk JOIN sn c ON c.symbol = pk.symbol AND c.bn = pk.bn + 8 JOIN a10_r ON a10_r.symbol = c.symbol AND a10_r.time = c.time),
lv AS (SELECT p.symbol, p.side, p.bn + 8 AS confirmed, (min(q.v) + max(q.v)) / 2 AS mid, any_value(p.band) AS band FROM pb p JOIN pk q ON q.symbol = p.symbol AND q.side = p.side AND q.k BETWEEN p.k - 20 AND p.k AND abs(q.v - p.v) <= p.band GROUP BY p.symbol, p.side, p.bn HAVING count(*) >= 3),
sw AS (SELECT l.*, (SELECT min(x.bn) FROM sn x WHERE x.symbol = l.symbol AND x.bn >= l.confirmed AND x.bn < l.confirmed + 500 AND CASE WHEN l.side > 0 THEN x.high ELSE -x.low END > l.mid + l.band) AS swept FROM lv l)"""


@query("liquidity_levels", f"WITH {_LIQ} SELECT symbol, CAST(side AS BIGINT) AS side, confirmed, round(CASE WHEN side > 0 THEN mid - band ELSE -mid - band END, 6) AS lower, round(CASE WHEN side > 0 THEN mid + band ELSE band - mid END, 6) AS upper, swept FROM sw", "hours")
def _(spark, d):
    return liquidity.swept_levels(liquidity.ranged(hourly(spark, d), SPAN))


@query("liquidity_sweeps", f"WITH {_LIQ} SELECT n.symbol, n.time, EXISTS (SELECT 1 FROM sw WHERE sw.symbol = n.symbol AND side > 0 AND n.bn BETWEEN swept AND swept + 11) AS buy_swept, EXISTS (SELECT 1 FROM sw WHERE sw.symbol = n.symbol AND side < 0 AND n.bn BETWEEN swept AND swept + 11) AS sell_swept FROM sn n", "hours")
def _(spark, d):
    return liquidity.sweeps(hourly(spark, d), SPAN).select("symbol", "time", "buy_swept", "sell_swept")


_GAPS = f"""{_NUM}, g0 AS (SELECT *, lag(high, 2) OVER ({_PART}) AS h2, lag(low, 2) OVER ({_PART}) AS l2, avg((high - low) / greatest(low, 1e-9)) OVER ({_PART} ROWS UNBOUNDED PRECEDING) AS lim FROM sn),
g1 AS (SELECT *, CASE WHEN low > h2 AND pc > h2 AND (low - h2) / h2 > lim THEN 1 WHEN high < l2 AND pc < l2 AND (l2 - high) / high > lim THEN -1 END AS side FROM g0),
bx AS (SELECT symbol, side, CASE WHEN side > 0 THEN h2 ELSE high END AS bottom, CASE WHEN side > 0 THEN low ELSE l2 END AS top, bn AS created, (SELECT min(x.bn) FROM sn x WHERE x.symbol = g1.symbol AND x.bn >= g1.bn AND CASE WHEN side > 0 THEN x.close < g1.h2 ELSE x.close > g1.l2 END) AS closed FROM g1 WHERE side IS NOT NULL)"""


@query("gap_boxes", f"WITH {_GAPS} SELECT symbol, CAST(side AS BIGINT) AS side, round(bottom, 6) AS bottom, round(top, 6) AS top, created, closed FROM bx", "hours")
def _(spark, d):
    return liquidity.boxes(liquidity.gaps(hourly(spark, d), SPAN))


@query("open_gap_boxes", f"WITH {_GAPS} SELECT n.symbol, n.time, count(*) FILTER (x.side > 0) AS bulls, count(*) FILTER (x.side < 0) AS bears, round(max(x.top) FILTER (x.side > 0), 6) AS support, round(min(x.bottom) FILTER (x.side < 0), 6) AS resistance FROM sn n LEFT JOIN bx x ON x.symbol = n.symbol AND x.created <= n.bn AND (x.closed IS NULL OR x.closed > n.bn) GROUP BY 1, 2", "hours")
def _(spark, d):
    return liquidity.open_boxes(hourly(spark, d), SPAN).select("symbol", "time", "bulls", "bears", "support", "resistance")


_SUPER = f"""{_NUM}, tr1 AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS trv FROM sn), {_recursive("a10", "trv", 10, 0.1, "tr1")},
sb AS (SELECT s.symbol, s.time, s.bn, s.close, s.pc, (s.high + s.low) / 2 + 3.0 * coalesce(y, 0.0) AS ub, (s.high + s.low) / 2 - 3.0 * coalesce(y, 0.0) AS lb FROM sn s LEFT JOIN a10_r a ON a.symbol = s.symbol AND a.time = s.time),
st AS (SELECT symbol, time, bn, ub AS u, lb AS l, -1 AS dir FROM sb WHERE bn = 0
UNION ALL SELECT symbol, time, bn, u, l, CASE WHEN d0 < 0 OR one THEN CASE WHEN close <= u THEN -1 ELSE 1 END WHEN close >= l THEN 1 ELSE -1 END
FROM (SELECT n.symbol, n.time, n.bn, n.close, r.dir AS d0, r.u = r.l AS one, CASE WHEN n.ub < r.u OR n.pc > r.u THEN n.ub ELSE r.u END AS u, CASE WHEN n.lb > r.l OR n.pc < r.l THEN n.lb ELSE r.l END AS l FROM st r JOIN sb n ON n.symbol = r.symbol AND n.bn = r.bn + 1) q)"""


@query("supertrend", f"WITH {_SUPER} SELECT symbol, time, round(u, 6) AS upper_band, round(l, 6) AS lower_band, CAST(dir AS BIGINT) AS direction, round(CASE WHEN dir > 0 THEN l ELSE u END, 6) AS supertrend FROM st", "hours")
def _(spark, d):
    x = ratchets.supertrend(frames.candle_parts(numbered(hourly(spark, d), span=SPAN)), SPAN, size=100)
    return x.select("symbol", "time", "upper_band", "lower_band", "direction", "supertrend")


_QQE = f"""{_NUM}, q0 AS (SELECT *, greatest(coalesce(close - pc, 0.0), 0.0) AS gain, greatest(coalesce(pc - close, 0.0), 0.0) AS loss FROM sn), {_recursive("qg", "gain", 1, 1 / 14, "q0")}, {_recursive("ql", "loss", 1, 1 / 14, "q0")},
q1 AS (SELECT g.symbol, g.time, CASE WHEN l.y > 0 THEN 100 - 100 / (1 + g.y / l.y) WHEN g.y > 0 THEN 100.0 END AS rsi FROM qg_r g JOIN ql_r l ON l.symbol = g.symbol AND l.time = g.time), {_recursive("qm", "rsi", 1, 2 / 6, "q1")},
q2 AS (SELECT symbol, time, y, abs(lag(y) OVER ({_PART}) - y) AS step FROM qm_r), {_recursive("qa", "step", 1, 2 / 28, "q2")}, q3 AS (SELECT symbol, time, y AS s1 FROM qa_r), {_recursive("qb", "s1", 1, 2 / 28, "q3")},
q4 AS (SELECT s.symbol, s.time, s.bn, coalesce(m.y, 0.0) AS r, coalesce(f.y, 0.0) * 4.238 AS far FROM sn s LEFT JOIN qm_r m ON m.symbol = s.symbol AND m.time = s.time LEFT JOIN qb_r f ON f.symbol = s.symbol AND f.time = s.time),
q5 AS (SELECT symbol, time, bn, r, CAST(0.0 AS DOUBLE) AS lo, CAST(0.0 AS DOUBLE) AS sh, 1 AS trend FROM q4 WHERE bn = 0
UNION ALL SELECT n.symbol, n.time, n.bn, n.r, CASE WHEN p.r > p.lo AND n.r > p.lo THEN greatest(p.lo, n.r - n.far) ELSE n.r - n.far END, CASE WHEN p.r < p.sh AND n.r < p.sh THEN least(p.sh, n.r + n.far) ELSE n.r + n.far END,
CASE WHEN p.r <= p.sh AND n.r > p.sh THEN 1 WHEN p.r >= p.lo AND n.r < p.lo THEN -1 ELSE p.trend END FROM q5 p JOIN q4 n ON n.symbol = p.symbol AND n.bn = p.bn + 1)"""


@query("qqe_bands", f"WITH {_QQE} SELECT symbol, time, round(r, 6) AS rsi_ma, round(lo, 6) AS longband, round(sh, 6) AS shortband, CAST(trend AS BIGINT) AS trend FROM q5", "hours")
def _(spark, d):
    return ratchets.qqe(numbered(hourly(spark, d), span=SPAN), SPAN, size=100).select("symbol", "time", "rsi_ma", "longband", "shortband", "trend")


#: Rows of the long frame: a year of quarter hours.
YEAR = 96 * 250
_LINES = "row_number() OVER (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"


@query("year_rank", f"""WITH x AS (SELECT l_linestatus AS symbol, {_LINES} AS rn, l_extendedprice AS price FROM lineitem)
SELECT a.symbol, a.rn, round(count(*) FILTER (b.price < a.price) / {float(YEAR)}, 6) AS share FROM x a JOIN x b ON b.symbol = a.symbol AND b.rn < a.rn AND b.rn >= a.rn - {YEAR} WHERE a.rn >= {YEAR} GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    # a series long enough for the frame: lines by day of shipping; their order is total but for equal rows
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ranks.trailing_share(_numbered_lines(li, order), "price", YEAR, "share").where("share IS NOT NULL").select("symbol", "rn", "share")


def _numbered_lines(li: DataFrame, order: list[str]) -> DataFrame:
    """symbol, rn, price: lines numbered within their status by day and then by the rest of the order, a task a month."""
    x = li.select(F.col("l_linestatus").alias("symbol"), *order, F.trunc(F.col("l_shipdate").cast("date"), "month").alias("_month"))
    sizes = x.groupBy(F.col("symbol").alias("_k"), F.col("_month").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("symbol", "_month").orderBy(*order)) - 1
    j = x.withColumn("_own", own).join(sizes.select("_k", "_m", before.alias("_before")), F.col("symbol").eqNullSafe(F.col("_k")) & F.col("_month").eqNullSafe(F.col("_m")))
    return j.select("symbol", (F.col("_before") + F.col("_own")).cast("long").alias("rn"), F.col("l_extendedprice").alias("price"))


#: Ticks of a symbol that a trade is held, and its risk in price.
HELD, RISK = 40, 25.0
CTE["held"] = f"""SELECT *, (CASE WHEN is_buy THEN 1 ELSE -1 END) * (exit_price - entry_price) / {RISK} AS r FROM (SELECT event_id AS trade_id, symbol AS strategy, event_id % 2 = 0 AS is_buy, t AS entry_time, price AS entry_price, lead(t, {HELD}) OVER (PARTITION BY symbol ORDER BY micros, event_id) AS exit_time, lead(price, {HELD}) OVER (PARTITION BY symbol ORDER BY micros, event_id) AS exit_price FROM ticks)"""
CTE["minutes"] = "SELECT CAST(floor(t / 60) * 60 AS BIGINT) AS time, max(price) AS high, min(price) AS low FROM ticks GROUP BY 1"
_EXC = f"""ee AS (SELECT h.trade_id, count(m.time) AS bars_held, any_value(h.strategy) AS strategy, any_value(h.r) AS r, any_value(h.entry_time) AS entry_time, any_value(h.exit_time) AS exit_time,
greatest(coalesce(max(CASE WHEN is_buy THEN m.high - entry_price ELSE entry_price - m.low END), 0.0), 0.0) / {RISK} AS mfe_r, least(coalesce(min(CASE WHEN is_buy THEN m.low - entry_price ELSE entry_price - m.high END), 0.0), 0.0) / {RISK} AS mae_r,
arg_min(m.time, (-CASE WHEN is_buy THEN m.high - entry_price ELSE entry_price - m.low END, m.time)) AS best FROM held h LEFT JOIN minutes m ON m.time >= h.entry_time AND m.time < h.exit_time GROUP BY 1),
ef AS (SELECT *, CASE WHEN mfe_r > 0 THEN CAST(floor((best - entry_time) / 60) + 1 AS BIGINT) ELSE 0 END AS minutes_to_mfe FROM ee)"""


def _excursions(spark, d) -> DataFrame:
    t = ticks(spark, d)
    w = Window.partitionBy("symbol").orderBy("micros", "event_id")
    held = t.select(
        F.lit("all").alias("market"), F.col("event_id").alias("trade_id"), F.col("symbol").alias("strategy"), (F.col("event_id") % 2 == 0).alias("is_buy"), F.col("t").alias("entry_time"), F.col("price").alias("entry_price"), F.lit(RISK).alias("risk"),
        F.lead("t", HELD).over(w).alias("exit_time"), F.lead("price", HELD).over(w).alias("exit_price"),
    )
    held = held.withColumn("r", F.when(F.col("is_buy"), 1).otherwise(-1) * (F.col("exit_price") - F.col("entry_price")) / RISK)
    minutes = t.groupBy(F.lit("all").alias("market"), (F.floor(F.col("t") / 60) * 60).alias("time")).agg(F.max("price").alias("high"), F.min("price").alias("low"))
    return ex.excursions(held, minutes, SPAN)


@query("trade_excursions", f"WITH {_EXC} SELECT trade_id, bars_held, round(mfe_r, 6) AS mfe_r, round(mae_r, 6) AS mae_r, minutes_to_mfe FROM ef", "held", "minutes")
def _(spark, d):
    return _excursions(spark, d).select("trade_id", "bars_held", "mfe_r", "mae_r", "minutes_to_mfe")


@query("excursion_summary", f"WITH {_EXC} SELECT strategy, count(*) AS trades, round(avg(mae_r), 6) AS avg_mae_r, round(avg(mfe_r), 6) AS avg_mfe_r, round(avg((exit_time - entry_time) / 60.0), 6) AS avg_minutes_open, round(quantile_cont((exit_time - entry_time) / 60.0, 0.5), 6) AS median_minutes_open, round(avg(minutes_to_mfe), 6) AS avg_minutes_to_mfe, round(coalesce(avg(r) / nullif(avg(mfe_r), 0), 0), 6) AS mfe_capture FROM ef WHERE exit_time IS NOT NULL GROUP BY 1", "held", "minutes")
def _(spark, d):
    return ex.excursion_summary(_excursions(spark, d).where("exit_time IS NOT NULL"), "strategy")


@query("bar_views", """WITH a AS (SELECT event_id, symbol, t FROM ticks), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS n FROM hours), l AS (SELECT a.event_id, a.symbol, a.t, k.n, k.close AS last_close FROM a ASOF JOIN k ON a.symbol = k.symbol AND a.t >= k.time + 3600)
SELECT l.event_id, count(*) + 1 AS bars, min(k.time) AS first_time, round(max(k.high), 6) AS highest, round(avg(k.close), 6) AS mean_close, l.t AS forming_time, round(l.last_close, 6) AS forming_close FROM l JOIN k ON k.symbol = l.symbol AND k.n BETWEEN l.n - 18 AND l.n WHERE l.n >= 19 GROUP BY l.event_id, l.t, l.last_close""", "hours")  # fmt: skip
def _(spark, d):
    t = ticks(spark, d)
    x = ex.histories(t.select("event_id", "symbol", "t"), hourly(spark, d), 20, 3600, "t", SPAN).where("view IS NOT NULL")
    closed, forming = F.slice("view", 1, 19), F.element_at("view", -1)
    mean = F.aggregate(closed, F.lit(0.0), lambda s, v: s + v["close"]) / 19
    return x.select("event_id", F.size("view").alias("bars"), closed[0]["time"].alias("first_time"), F.array_max(F.transform(closed, lambda v: v["high"])).alias("highest"), mean.alias("mean_close"), forming["time"].alias("forming_time"), forming["close"].alias("forming_close"))


@query("nearest_orders", """WITH c AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), o AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ot, event_id AS order_id FROM events WHERE event_type = 'view')
SELECT c.event_id, CASE WHEN c.t - o.ot < 86400 THEN o.order_id END AS order_id FROM c ASOF LEFT JOIN o ON o.user_id = c.user_id AND c.t >= o.ot""")  # fmt: skip
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    orders = e.where("event_type = 'view'").select("user_id", F.col("t").alias("ot"), F.col("event_id").alias("order_id"))
    return ex.nearest_prior(e.where("event_type = 'purchase'"), orders, ["order_id"], 86_400, 5 * 86_400, "t", "ot", "user_id").select("event_id", "order_id")


# The reason that a log records for a trade's close: the next event of the trade's user names it.
@query("recorded_exit_reasons", """WITH t AS (SELECT event_id AS trade_id, user_id, event_type AS strategy, value - 50.0 AS net_pl, ts FROM events), c AS (SELECT trade_id, strategy, net_pl, CASE lead(strategy) OVER (PARTITION BY user_id ORDER BY ts, trade_id) WHEN 'error' THEN '' ELSE lead(strategy) OVER (PARTITION BY user_id ORDER BY ts, trade_id) END AS reason FROM t),
g AS (SELECT strategy, CASE WHEN reason IS NULL THEN 'open' WHEN reason = '' THEN 'unknown' ELSE reason END AS reason, count(*) AS trades, sum(net_pl) AS net_pl, 100.0 * count(*) FILTER (net_pl > 0) / count(*) AS win_rate FROM c GROUP BY 1, 2)
SELECT strategy, reason, trades, round(net_pl, 6) AS net_pl, round(win_rate, 6) AS win_rate, round(trades / sum(trades) OVER (PARTITION BY strategy), 6) AS share FROM g""")  # fmt: skip
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = e.select(F.col("event_id").alias("trade_id"), F.col("event_type").alias("strategy"), (F.col("value") - 50.0).alias("net_pl"), nxt.alias("_next"))
    closes = x.where("_next IS NOT NULL").select("trade_id", F.when(F.col("_next") == "error", "").otherwise(F.col("_next")).alias("reason"))
    return ex.closed_reasons(x.drop("_next"), closes)
