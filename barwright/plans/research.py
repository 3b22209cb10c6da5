"""Queries on market structure, stop-and-reverse, state rules and the tier-1 screen of rules, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import barriers, folds, frames, gates, recurrences, rules, structure
from barwright.operators.blocks import numbered
from barwright.plans.market import _ALL, _D1, _FEAT, _PART, _SIGS, HOUR, _raced, _recursive, hourly, query
from barwright.staging import staged

_SAR = """nb0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS bn FROM hours),
sar0 AS (SELECT symbol, bn, true AS up, CAST(0.02 AS DOUBLE) AS af, high AS ep, low AS lev, CAST(NULL AS DOUBLE) AS sar, low AS l1, low AS l2, high AS h1, high AS h2 FROM nb0 WHERE bn = 1
UNION ALL SELECT symbol, bn, up <> turn, CASE WHEN turn THEN 0.02 WHEN further THEN least(af + 0.02, 0.2) ELSE af END, CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN further THEN CASE WHEN up THEN high ELSE low END ELSE ep END,
CASE WHEN NOT turn THEN c WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, CASE WHEN NOT turn THEN c WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, low, l1, high, h1
FROM (SELECT *, CASE WHEN up THEN low < c ELSE high > c END AS turn, CASE WHEN up THEN high > ep ELSE low < ep END AS further FROM (SELECT n.symbol, n.bn, r.up, r.af, r.ep, r.l1, r.h1, n.high, n.low, CASE WHEN r.up THEN least(r.lev + r.af * (r.ep - r.lev), r.l1, r.l2) ELSE greatest(r.lev + r.af * (r.ep - r.lev), r.h1, r.h2) END AS c
FROM sar0 r JOIN nb0 n ON n.symbol = r.symbol AND n.bn = r.bn + 1) a) b)"""

#: Pivots by counting, breaks by comparison, trend and order blocks by recursion over bars: not the frames that the operator uses.
_STRUCT = """sn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS bn, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY time), close) AS before FROM hours),
pv AS (SELECT a.symbol, a.bn, count(*) = 21 AND count(*) FILTER (b.high >= a.high) = 1 AS ph, count(*) = 21 AND count(*) FILTER (b.low <= a.low) = 1 AS pl FROM sn a JOIN sn b ON a.symbol = b.symbol AND b.bn BETWEEN a.bn - 10 AND a.bn + 10 GROUP BY 1, 2),
vis AS (SELECT s.*, (SELECT max(p.bn) FROM pv p WHERE p.symbol = s.symbol AND p.ph AND p.bn <= s.bn - 10) AS hr, (SELECT max(p.bn) FROM pv p WHERE p.symbol = s.symbol AND p.pl AND p.bn <= s.bn - 10) AS lr FROM sn s),
lev AS (SELECT v.*, a.high AS ph, b.low AS pl, coalesce(v.before <= a.high AND v.close > a.high, false) AS up, coalesce(v.before >= b.low AND v.close < b.low, false) AS dn FROM vis v LEFT JOIN sn a ON a.symbol = v.symbol AND a.bn = v.hr LEFT JOIN sn b ON b.symbol = v.symbol AND b.bn = v.lr),
ob AS (SELECT l.symbol, l.bn, arg_min({'lo': x.low, 'hi': x.high}, (x.low, x.bn)) FILTER (l.up AND x.bn >= l.hr) AS bu, arg_min({'lo': x.low, 'hi': x.high}, (-x.high, x.bn)) FILTER (l.dn AND x.bn >= l.lr) AS be FROM lev l JOIN sn x ON x.symbol = l.symbol AND x.bn <= l.bn WHERE l.up OR l.dn GROUP BY 1, 2),
lo AS (SELECT lev.*, ob.bu.lo AS bul, ob.bu.hi AS buh, ob.be.lo AS bel, ob.be.hi AS beh FROM lev LEFT JOIN ob ON ob.symbol = lev.symbol AND ob.bn = lev.bn),
st0 AS (SELECT symbol, bn, -1 AS trend, 0 AS event, CAST(NULL AS DOUBLE) AS bull_low, CAST(NULL AS DOUBLE) AS bull_high, CAST(NULL AS DOUBLE) AS bear_low, CAST(NULL AS DOUBLE) AS bear_high FROM lo WHERE bn = 1
UNION ALL SELECT symbol, bn, trend, event, CASE WHEN close >= a THEN a END, CASE WHEN close >= a THEN b END, CASE WHEN close <= d THEN c END, CASE WHEN close <= d THEN d END
FROM (SELECT n.symbol, n.bn, n.close, CASE WHEN n.up THEN 1 WHEN n.dn THEN -1 ELSE r.trend END AS trend, CASE WHEN n.up AND r.trend < 0 THEN 2 WHEN n.dn AND r.trend > 0 THEN -2 WHEN n.up THEN 1 WHEN n.dn THEN -1 ELSE 0 END AS event,
CASE WHEN n.up THEN n.bul ELSE r.bull_low END AS a, CASE WHEN n.up THEN n.buh ELSE r.bull_high END AS b, CASE WHEN n.dn THEN n.bel ELSE r.bear_low END AS c, CASE WHEN n.dn THEN n.beh ELSE r.bear_high END AS d FROM st0 r JOIN lo n ON n.symbol = r.symbol AND n.bn = r.bn + 1) q)"""


@query("parabolic_sar", f"WITH {_SAR} SELECT n.symbol, n.time, round(s.sar, 6) AS sar FROM sar0 s JOIN nb0 n ON n.symbol = s.symbol AND n.bn = s.bn", "hours")
def _(spark, d):
    return folds.parabolic_sar(hourly(spark, d)).select("symbol", "time", "sar")


@query("pivot_levels", f"WITH {_STRUCT} SELECT symbol, time, round(ph, 6) AS pivot_high, round(pl, 6) AS pivot_low FROM lev WHERE ph IS NOT NULL AND pl IS NOT NULL", "hours")
def _(spark, d):
    return structure.pivots(hourly(spark, d)).where("pivot_high IS NOT NULL AND pivot_low IS NOT NULL").select("symbol", "time", "pivot_high", "pivot_low")


@query("structure_events", f"WITH {_STRUCT} SELECT n.symbol, n.time, CAST(trend AS BIGINT) AS trend, CAST(event AS BIGINT) AS event FROM st0 s JOIN sn n ON n.symbol = s.symbol AND n.bn = s.bn", "hours")
def _(spark, d):
    return structure.structure(hourly(spark, d)).select("symbol", "time", "trend", "event")


@query("order_blocks", f"WITH {_STRUCT} SELECT n.symbol, n.time, round(bull_low, 6) AS bull_low, round(bull_high, 6) AS bull_high, round(bear_low, 6) AS bear_low, round(bear_high, 6) AS bear_high FROM st0 s JOIN sn n ON n.symbol = s.symbol AND n.bn = s.bn WHERE bull_low IS NOT NULL OR bear_low IS NOT NULL", "hours")
def _(spark, d):
    return structure.structure(hourly(spark, d)).where("bull_low IS NOT NULL OR bear_low IS NOT NULL").select("symbol", "time", "bull_low", "bull_high", "bear_low", "bear_high")


_STATE = f"""{_ALL}, {_recursive("e7", "close", 7, 2 / 8, "ind")}, {_recursive("e21", "close", 21, 2 / 22, "ind")}, {_SAR}, {_STRUCT},
sf AS (SELECT ind.*, e7_r.y AS ema7, e21_r.y AS ema21, sar0.sar, st0.event, st0.bull_low, st0.bull_high, st0.bear_low, st0.bear_high, max(ind.high) OVER w5 AS hh5, min(ind.low) OVER w5 AS ll5, avg(ind.tick_volume) OVER w20 AS vm, count(*) OVER w20 AS vk
FROM ind JOIN nb0 ON nb0.symbol = ind.symbol AND nb0.time = ind.time LEFT JOIN e7_r ON e7_r.symbol = ind.symbol AND e7_r.time = ind.time LEFT JOIN e21_r ON e21_r.symbol = ind.symbol AND e21_r.time = ind.time LEFT JOIN sar0 ON sar0.symbol = nb0.symbol AND sar0.bn = nb0.bn LEFT JOIN st0 ON st0.symbol = nb0.symbol AND st0.bn = nb0.bn
WINDOW w5 AS (PARTITION BY ind.symbol ORDER BY ind.time ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY ind.symbol ORDER BY ind.time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ss AS (SELECT symbol, time, 'ema_sar_full' AS rule, CASE WHEN ema7 < ema21 AND ema21 < ema200 AND close < ema7 AND close < sar AND adx14 > 25 AND high > hh5 AND vk = 20 AND tick_volume > vm THEN -1 WHEN ema7 > ema21 AND ema21 > ema200 AND close > ema7 AND close > sar AND adx14 > 25 AND low < ll5 AND vk = 20 AND tick_volume > vm THEN 1 ELSE 0 END AS signal FROM sf
UNION ALL SELECT symbol, time, 'ema_sar_simple', CASE WHEN close < ema200 AND close < sar THEN -1 WHEN close > ema200 AND close > sar THEN 1 ELSE 0 END FROM sf
UNION ALL SELECT symbol, time, 'structure_break_choch', CASE event WHEN 2 THEN 1 WHEN -2 THEN -1 ELSE 0 END FROM sf
UNION ALL SELECT symbol, time, 'structure_break_bos', CASE event WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END FROM sf
UNION ALL SELECT symbol, time, 'order_block', CASE WHEN high >= bear_low AND close <= bear_high AND close < open THEN -1 WHEN low <= bull_high AND close >= bull_low AND close > open THEN 1 ELSE 0 END FROM sf)"""


@query("state_rule_signals", f"WITH {_STATE} SELECT symbol, time, rule, CAST(signal AS BIGINT) AS signal FROM ss WHERE signal <> 0", "hours", "candles")
def _(spark, d):
    return rules.signals(rules.state_features(hourly(spark, d)), rules.STATE_RULES).select("symbol", "time", "rule", "signal")


_GREEDY = "SELECT {0} FROM (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY pos) AS k FROM {2}) WHERE k = 1 UNION ALL SELECT {3} FROM gr JOIN {2} n ON {4} AND n.pos = gr.nxt"


@query("signals_debounced", f"""WITH {_FEAT}, {_SIGS}, bo AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) AS bn FROM hours), sd AS (SELECT s.symbol, bn AS pos, s.time, rule, family, signal, min(bn) OVER (PARTITION BY s.symbol, rule ORDER BY bn RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM sigs s JOIN bo ON bo.symbol = s.symbol AND bo.time = s.time WHERE signal <> 0),
gr AS ({_GREEDY.format("symbol, pos, time, rule, family, signal, nxt", "symbol, rule", "sd", "n.*", "n.symbol = gr.symbol AND n.rule = gr.rule")}) SELECT symbol, time, rule, family, CAST(signal AS BIGINT) AS signal FROM gr""", "hours", "candles")  # fmt: skip
def _(spark, d):
    x = staged(numbered(hourly(spark, d), span=5 * 86_400), "bars")
    found = rules.signals(rules.features(x.drop("rn"))).join(x.select("symbol", "time", "rn"), ["symbol", "time"])
    return rules.debounced(found, 4).drop("rn")


def _race_sql(tag: str, entries: str, target: float, stop: float, most: int) -> str:
    """Race, result in R, and greedy choice for signals (grp, symbol, rn, side) in the table ``entries``."""
    return f"""en{tag} AS (SELECT DISTINCT s.symbol, s.rn, s.side, b.o1 + CASE WHEN s.side > 0 THEN b.sp1 ELSE 0 END AS entry, b.atr14 AS a FROM {entries} s JOIN bb b ON b.symbol = s.symbol AND b.rn = s.rn WHERE b.atr14 > 0 AND b.third IS NOT NULL),
hit{tag} AS (SELECT e.symbol, e.rn, e.side, e.entry, e.a, b.rn AS j, b.close + CASE WHEN e.side > 0 THEN 0 ELSE b.spread END AS c, CASE WHEN e.side > 0 THEN b.low <= e.entry - {stop} * e.a ELSE b.high + b.spread >= e.entry + {stop} * e.a END AS s, CASE WHEN e.side > 0 THEN b.high >= e.entry + {target} * e.a ELSE b.low + b.spread <= e.entry - {target} * e.a END AS t FROM en{tag} e JOIN bb b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + {most}),
ra{tag} AS (SELECT symbol, rn, side, any_value(entry) AS entry, any_value(a) AS a, min(j) FILTER (s) AS sj, min(j) FILTER (t) AS tj, min(j) FILTER (s AND t) AS bj, max(j) AS lj, arg_max(c, j) AS lc FROM hit{tag} GROUP BY 1, 2, 3),
oc{tag} AS (SELECT symbol, rn, side, least(coalesce(sj, lj), coalesce(tj, lj)) AS exit_rn, CASE WHEN sj <= coalesce(tj, sj) THEN -1 WHEN tj IS NOT NULL THEN 1 ELSE 0 END AS outcome, bj, CASE WHEN sj <= coalesce(tj, sj) THEN -1.0 WHEN tj IS NOT NULL THEN {target} / {stop} ELSE side * (lc - entry) / a / {stop} END AS r FROM ra{tag}),
js{tag} AS (SELECT s.grp, s.symbol, s.rn AS pos, o.exit_rn, o.outcome, o.r, s.side, coalesce(o.bj <= o.exit_rn, false) AS amb FROM {entries} s JOIN oc{tag} o ON o.symbol = s.symbol AND o.rn = s.rn AND o.side = s.side),
jn{tag} AS (SELECT a.*, (SELECT min(b.pos) FROM js{tag} b WHERE b.grp = a.grp AND b.symbol = a.symbol AND b.pos > a.exit_rn) AS nxt FROM js{tag} a),
tr{tag} AS (SELECT grp, symbol, pos, exit_rn, outcome, r, side, amb, nxt FROM (SELECT *, row_number() OVER (PARTITION BY grp, symbol ORDER BY pos) AS k FROM jn{tag}) WHERE k = 1 UNION ALL SELECT n.grp, n.symbol, n.pos, n.exit_rn, n.outcome, n.r, n.side, n.amb, n.nxt FROM tr{tag} g JOIN jn{tag} n ON n.grp = g.grp AND n.symbol = g.symbol AND n.pos = g.nxt)"""


_BARS = f"bb AS (SELECT *, lead(open) OVER ({_PART}) AS o1, lead(spread) OVER ({_PART}) AS sp1, lead(rn, 2) OVER ({_PART}) AS third, max(rn) OVER (PARTITION BY symbol) AS total FROM (SELECT *, 0.01 * (tick_volume % 5) AS spread, row_number() OVER ({_PART}) AS rn FROM ind))"
#: Barriers in ranges, bars, and bars of warm-up of the screen.
TARGET, STOP, MOST, WARM_UP = 3.0, 1.5, 24, 250
_SCREEN = f"{_FEAT}, {_SIGS}, {_BARS}, sg AS (SELECT s.rule AS grp, s.symbol, b.rn, s.signal AS side FROM sigs s JOIN bb b ON b.symbol = s.symbol AND b.time = s.time WHERE s.signal <> 0 AND b.rn > {WARM_UP}), {_race_sql('1', 'sg', TARGET, STOP, MOST)}"
_FOUND = """sc AS (SELECT grp AS rule, symbol, count(*) AS trades, count(*) FILTER (r > 0) AS wins, avg(r) AS expectancy_r, sum(r) AS total_r, sum(r) FILTER (r > 0) / nullif(-sum(r) FILTER (r < 0), 0) AS pf, avg(exit_rn - pos) AS bars_held, count(*) FILTER (outcome = 0) AS timeouts, count(*) FILTER (amb) AS ambiguous, count(*) FILTER (side > 0) AS longs FROM tr1 GROUP BY 1, 2),
dd AS (SELECT rule, symbol, max(top - eq) AS fall FROM (SELECT grp AS rule, symbol, eq, greatest(0.0, max(eq) OVER (PARTITION BY grp, symbol ORDER BY pos)) AS top FROM (SELECT *, sum(r) OVER (PARTITION BY grp, symbol ORDER BY pos) AS eq FROM tr1)) GROUP BY 1, 2)"""


def _screen(spark, d) -> tuple[DataFrame, DataFrame]:
    b = barriers.numbered(hourly(spark, d)).withColumn("spread", 0.01 * (F.col("tick_volume") % 5))
    x = staged(rules.features(b), "features")
    s = rules.signals(x).join(x.select("symbol", "time", "rn"), ["symbol", "time"]).where(F.col("rn") > WARM_UP).select("rule", "symbol", "rn", F.col("signal").alias("side"))
    bars = x.select("symbol", "rn", "open", "high", "low", "close", "spread", "atr14")
    return bars, staged(barriers.simulated(bars, s, TARGET, STOP, MOST, ("rule",)), "trades")


@query("rule_screen", f"WITH {_SCREEN}, {_FOUND} SELECT rule, symbol, trades, wins, round(expectancy_r, 6) AS expectancy_r, round(total_r, 6) AS total_r, round(coalesce(pf, CASE WHEN wins = 0 THEN 0.0 END), 6) AS profit_factor, round(fall, 6) AS max_dd_r, round(bars_held, 6) AS bars_held, timeouts, ambiguous, longs FROM sc JOIN dd USING (rule, symbol)", "hours", "candles")
def _(spark, d):
    return barriers.screened(_screen(spark, d)[1], "rule", "symbol")


_CONTROL = f"""dr AS (SELECT symbol, rn, rep, row_number() OVER (PARTITION BY symbol, rep ORDER BY md5(symbol || ':' || rep || ':' || rn), rn) AS k FROM bb, range(8) q(rep) WHERE rn > {WARM_UP + 1} AND rn < total - {MOST} - 1 AND atr14 IS NOT NULL AND symbol IN (SELECT symbol FROM bb WHERE rn > {WARM_UP + 1} AND rn < total - {MOST} - 1 AND atr14 IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)),
sg2 AS (SELECT c.rule || '#' || dr.rep AS grp, dr.symbol, dr.rn, CASE WHEN CAST(CAST('0x' || md5('side:' || dr.rep || ':' || dr.rn)[1:13] AS UBIGINT) AS DOUBLE) / {float(2**52)} < c.longs / c.trades THEN 1 ELSE -1 END AS side FROM dr JOIN sc c ON c.symbol = dr.symbol AND c.trades >= 20 AND dr.k <= 2 * c.trades)"""


@query("screen_edges", f"""WITH {_SCREEN}, {_FOUND}, {_CONTROL}, {_race_sql('2', 'sg2', TARGET, STOP, MOST)}, cx AS (SELECT split_part(grp, '#', 1) AS rule, grp, symbol, avg(r) AS e FROM tr2 GROUP BY 1, 2, 3 HAVING count(*) >= 5), cc AS (SELECT rule, symbol, avg(e) AS m, stddev_pop(e) AS s FROM cx GROUP BY 1, 2)
SELECT sc.rule, sc.symbol, sc.trades, round(sc.expectancy_r, 6) AS expectancy_r, round(m, 6) AS control_r, round(s, 6) AS control_sd, round(CASE WHEN s > 0 THEN sc.expectancy_r - m END, 6) AS edge_r, round(CASE WHEN s > 0 THEN (sc.expectancy_r - m) / s END, 5) AS edge_z FROM sc LEFT JOIN cc ON cc.rule = sc.rule AND cc.symbol = sc.symbol""", "hours", "candles")  # fmt: skip
def _(spark, d):
    bars, trades = _screen(spark, d)
    found = staged(barriers.screened(trades, "rule", "symbol"), "screened")
    controls = barriers.simulated(bars, staged(barriers.random_entries(bars, found, 8, MOST, WARM_UP), "entries"), TARGET, STOP, MOST, ("rule", "rep"))
    per = controls.groupBy("rule", "symbol", "rep").agg(F.count(F.lit(1)).alias("trades"), F.avg("r").alias("expectancy_r"))
    x = barriers.edges(found, per)
    return x.select("rule", "symbol", "trades", "expectancy_r", "control_r", "control_sd", "edge_r", F.round("edge_z", 5).alias("edge_z"))


@query("screen_one_at_a_time", f"""WITH {_ALL}, bb0 AS (SELECT * EXCLUDE (tick_volume), 0 AS tick_volume FROM ind), {_BARS.replace("FROM ind)", "FROM bb0)")}, sg AS (SELECT 'all' AS grp, symbol, rn, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM bb WHERE o1 IS NOT NULL AND atr14 > 0), {_race_sql('1', 'sg', TARGET, STOP, MOST).replace(" AND b.third IS NOT NULL", "")}
SELECT symbol, pos AS rn, CAST(side AS BIGINT) AS side, CAST(outcome AS BIGINT) AS outcome, exit_rn FROM tr1""", "hours", "candles")  # fmt: skip
def _(spark, d):
    return barriers.one_at_a_time(_raced(spark, d)[1].select("symbol", "rn", "side", "outcome", "exit_rn"))


@query("signal_gates", f"""WITH {_ALL}, {_D1}, x AS (SELECT days.symbol, days.time + 86400 AS closed, CASE WHEN close > y THEN 1 WHEN close < y THEN -1 WHEN y IS NOT NULL THEN 0 END AS bias FROM days LEFT JOIN d10_r ON d10_r.symbol = days.symbol AND d10_r.time = days.time),
g AS (SELECT i.symbol, i.time, CASE WHEN i.close > i.open THEN 1 ELSE -1 END AS side, x.bias, i.tick_volume AS points, i.atr14, lag(i.atr14, 3) OVER (PARTITION BY i.symbol ORDER BY i.time) AS a3 FROM ind i ASOF LEFT JOIN x ON i.symbol = x.symbol AND i.time >= x.closed)
SELECT symbol, time, coalesce(CASE WHEN points > 4 THEN 'spread' END, CASE WHEN atr14 < 5 OR atr14 > 45 THEN 'volatility' END, CASE WHEN bias <> 0 AND bias <> side THEN 'bias' END, CASE WHEN a3 > 0 AND atr14 < 0.7 * a3 THEN 'consolidation' END, 'none') AS reason FROM g""", "hours", "days", "candles")  # fmt: skip
def _(spark, d):
    from barwright.operators import bars as b

    h = hourly(spark, d)
    x = gates.daily_bias(recurrences.indicators(frames.candle_parts(h), 5 * 86_400), b.coarser(h, 86_400, 19_800), 10)
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    x = x.withColumn("shrank", gates.shrank("atr14", frames.series()))
    why = gates.first_reason(("spread", gates.spread(F.col("tick_volume"), 4)), ("volatility", gates.volatility(F.col("atr14"), 5.0, 45.0)), ("bias", gates.direction(side, F.col("bias"))), ("consolidation", ~F.col("shrank")))
    return x.select("symbol", "time", F.coalesce(why, F.lit("none")).alias("reason"))
