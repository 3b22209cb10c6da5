"""Gates, grids, stress, regimes, resampled paths and held-out time, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import barriers, frames, recurrences, rules, structure, validation
from barwright.operators.blocks import numbered
from barwright.plans.market import _ALL, _FEAT, _PART, _SIGS, hourly, query
from barwright.plans.portfolio import SIMS, _hash_sql, _trades
from barwright.plans.research import _BARS, _STRUCT, WARM_UP
from barwright.plans.screens import _EXITS, _PF
from barwright.staging import staged

SPAN = 5 * 86_400
#: Exits of the grid (stops and targets of the sweep, the target at least the stop), and scales of the middle one.
STOPS, TARGETS, SCALES, COSTS, GRID_HOLD = (0.1, 0.3, 0.5, 1.0), (1.0, 1.5, 2.0, 3.0), (0.8, 0.9, 1.0, 1.1, 1.2), (1.0, 1.5, 2.0, 3.0), 48
GRID = [(t, s) for s in STOPS for t in TARGETS if t >= s]


def _indicators(spark, d) -> DataFrame:
    return recurrences.indicators(frames.candle_parts(numbered(hourly(spark, d), span=SPAN)), SPAN)


def _side(x: DataFrame) -> DataFrame:
    return x.select("symbol", "time", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("signal"))


@query("midnight_gate", f"""WITH {_ALL}, s AS (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS side, CAST(floor((time + 19800) / 86400) AS BIGINT) * 86400 + 14400 AS mid FROM ind), m AS (SELECT s.*, CASE WHEN s.time >= mid THEN b.close END AS midnight FROM s ASOF LEFT JOIN ind b ON b.symbol = s.symbol AND s.mid >= b.time)
SELECT symbol, time, CAST(side AS BIGINT) AS signal, round(midnight, 6) AS midnight, coalesce(CASE WHEN ema20 IS NULL THEN false WHEN close <= ema20 THEN side < 0 AND close < midnight ELSE side > 0 AND close > midnight END, false) AS blocked FROM m""", "hours", "candles")  # fmt: skip
def _(spark, d):
    x = staged(_indicators(spark, d), "indicators")
    return validation.midnight_gate(_side(x), x, SPAN).select("symbol", "time", "signal", "midnight", "blocked")


@query("clean_reversals", f"""WITH {_ALL}, p AS (SELECT *, abs(close - open) / greatest(high - low, 1e-9) > 0.55 AS strong, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1, lag(ema20) OVER w AS e1 FROM ind WINDOW w AS ({_PART}))
SELECT symbol, time, coalesce(close < open AND strong AND close < l1, false) OR coalesce(close < ema20 AND c1 >= e1, false) AS against_long, coalesce(close > open AND strong AND close > h1, false) OR coalesce(close > ema20 AND c1 <= e1, false) AS against_short FROM p""", "hours", "candles")  # fmt: skip
def _(spark, d):
    return validation.clean_reversals(staged(_indicators(spark, d), "indicators")).select("symbol", "time", "against_long", "against_short")


@query("confluence_filter", f"""WITH {_ALL}, {_STRUCT}, c AS (SELECT i.symbol, i.time, i.close, i.atr14, CASE WHEN i.close > i.open THEN 1 ELSE -1 END AS side, s.* EXCLUDE (symbol, bn) FROM ind i JOIN sn n ON n.symbol = i.symbol AND n.time = i.time JOIN st0 s ON s.symbol = n.symbol AND s.bn = n.bn)
SELECT symbol, time, CAST(side AS BIGINT) AS signal, trend = side AS agrees, coalesce(CASE WHEN side > 0 THEN close >= bull_low - atr14 AND close <= bull_high + atr14 ELSE close >= bear_low - atr14 AND close <= bear_high + atr14 END, false) AS near FROM c""", "hours", "candles")  # fmt: skip
def _(spark, d):
    x = structure.structure(staged(_indicators(spark, d).drop("rn"), "indicators"))
    return validation.confluence(_side(x), staged(x, "structure")).select("symbol", "time", "signal", "agrees", "near")


def _signals(spark, d) -> tuple[DataFrame, DataFrame]:
    """Bars and the signals of a reverting and a breaking rule, after the warm-up."""
    b = barriers.numbered(hourly(spark, d)).withColumn("spread", 0.01 * (F.col("tick_volume") % 5))
    x = staged(rules.features(b), "features")
    s = rules.signals(x, [r for r in rules.RULES if r.name in ("bb_fade", "donchian_break")]).join(x.select("symbol", "time", "rn"), ["symbol", "time"]).where(F.col("rn") > WARM_UP)
    s = s.groupBy("symbol", "rn").agg(F.max("signal").alias("side"))
    return x.select("symbol", "rn", "open", "high", "low", "close", "spread", "atr14"), staged(s, "signals")


def _tried(exits: str) -> str:
    """SQL: trades of the two rules' signals for each row of exits (id, target, stop)."""
    return f"{_FEAT}, {_SIGS}, {_BARS}, one AS (SELECT s.symbol, b.rn, max(s.signal) AS side FROM sigs s JOIN bb b ON b.symbol = s.symbol AND b.time = s.time WHERE s.rule IN ('bb_fade', 'donchian_break') AND s.signal <> 0 AND b.rn > {WARM_UP} GROUP BY 1, 2), ex(id, target, stop) AS (VALUES {exits}), every AS (SELECT id, symbol, rn, side, target, stop, {GRID_HOLD} AS hold FROM one, ex), {_EXITS}"


def _pair(t: float, s: float) -> str:
    return f"('{t:.3f}/{s:.3f}', {t}e0, {s}e0)"


_STATS = f"count(*) AS trades, count(*) FILTER (r > 0) AS wins, round(sum(r), 6) AS total_r, round({_PF}, 6) AS profit_factor, count(*) FILTER (outcome = 0) AS timeouts"


def _stats(t: DataFrame, *keys: str) -> DataFrame:
    gain, loss = F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("r") > 0).alias("wins"), F.sum("r").alias("total_r"), F.when(loss > 0, F.try_divide(gain, loss)).when(gain == 0, 0.0).alias("profit_factor"), F.count_if(F.col("outcome") == 0).alias("timeouts"))


@query("exit_grid", f"WITH {_tried(', '.join(_pair(*x) for x in GRID))} SELECT id AS exit, {_STATS} FROM trd GROUP BY 1", "hours", "candles")
def _(spark, d):
    bars, s = _signals(spark, d)
    return _stats(validation.exit_grid(bars, s, GRID, GRID_HOLD), "exit")


@query("exit_perturbation", f"WITH {_tried(', '.join(_pair(round(3.0 * k, 6), round(1.5 * k, 6)) for k in SCALES))}, g AS (SELECT id AS exit, {_STATS} FROM trd GROUP BY 1) SELECT *, profit_factor > 1.2 AS stands FROM g", "hours", "candles")
def _(spark, d):
    bars, s = _signals(spark, d)
    out = _stats(validation.exit_grid(bars, s, [(round(3.0 * k, 6), round(1.5 * k, 6)) for k in SCALES], GRID_HOLD), "exit")
    return out.withColumn("stands", F.round("profit_factor", 6) > 1.2)


@query("cost_stress", " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_tried('(1, 3e0, 1.5e0)').replace('0.01 * (tick_volume % 5) AS spread', f'{m}e0 * (0.01 * (tick_volume % 5)) AS spread')} SELECT {m}e0 AS cost, {_STATS} FROM trd HAVING count(*) > 0)" for m in COSTS), "hours", "candles")
def _(spark, d):
    bars, s = _signals(spark, d)
    return _stats(validation.cost_stress(bars, s.withColumns({"target": F.lit(3.0), "stop": F.lit(1.5)}), list(COSTS), GRID_HOLD), "cost")


@query("trade_regimes", f"""WITH {_ALL}, b AS (SELECT symbol, time, close, atr14, CASE WHEN count(*) OVER w = 120 THEN avg(close) OVER w END AS m FROM ind WINDOW w AS ({_PART} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)), q AS (SELECT symbol, quantile_cont(atr14, 0.2) AS a, quantile_cont(atr14, 0.4) AS b, quantile_cont(atr14, 0.6) AS c, quantile_cont(atr14, 0.8) AS d FROM ind GROUP BY 1),
j AS (SELECT t.strategy, t.net_pl, b.close > b.m AS up, CASE WHEN b.atr14 IS NOT NULL THEN CAST(q.a < atr14 AS INT) + CAST(q.b < atr14 AS INT) + CAST(q.c < atr14 AS INT) + CAST(q.d < atr14 AS INT) END AS f FROM trades t ASOF JOIN b ON b.symbol = t.strategy AND t.entry_time >= b.time JOIN q ON q.symbol = t.strategy),
k AS (SELECT net_pl, unnest([CASE WHEN up THEN 'trend_up' ELSE 'trend_down' END, 'range_' || f, 'leg_' || strategy]) AS regime FROM j WHERE up IS NOT NULL AND f IS NOT NULL)
SELECT regime, count(*) AS trades, round(sum(greatest(net_pl, 0.0)) / nullif(sum(greatest(-net_pl, 0.0)), 0), 6) AS profit_factor, round(sum(net_pl), 6) AS net_pl, round(100.0 * count(*) FILTER (net_pl > 0) / count(*), 6) AS win_rate FROM k GROUP BY 1""", "hours", "candles", "trades")  # fmt: skip
def _(spark, d):
    x = staged(_indicators(spark, d), "indicators")
    return validation.regimes(_trades(spark, d).withColumn("symbol", F.col("strategy")), x, SPAN, 120)


_PATHS = f"""WITH n AS (SELECT strategy, net_pl, row_number() OVER (PARTITION BY strategy ORDER BY trade_id) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM trades), h AS ({_hash_sql(f"(SELECT strategy, n, i AS trade_id FROM n), range({SIMS}) r(sim)", "sim", "strategy, sim, n, trade_id")}),
p AS (SELECT h.strategy, h.sim, h.trade_id AS place, n.net_pl FROM h JOIN n ON n.strategy = h.strategy AND n.i = h.h % h.n), b AS (SELECT *, 1000.0 + sum(net_pl) OVER (PARTITION BY strategy, sim ORDER BY place ROWS UNBOUNDED PRECEDING) AS balance FROM p),
f AS (SELECT *, greatest(1000.0, max(balance) OVER (PARTITION BY strategy, sim ORDER BY place ROWS UNBOUNDED PRECEDING)) AS peak FROM b),
s AS (SELECT strategy, sim, sum(greatest(net_pl, 0.0)) / nullif(sum(greatest(-net_pl, 0.0)), 0) AS pf, max(100.0 * (peak - balance) / peak) AS dd, min(balance) AS low FROM f GROUP BY 1, 2)"""


@query("monte_carlo_paths", f"""{_PATHS}, g AS (SELECT strategy, count(*) AS sims, quantile_cont(pf, 0.05) AS a, quantile_cont(pf, 0.5) AS b, quantile_cont(pf, 0.95) AS c, quantile_cont(dd, 0.5) AS d, quantile_cont(dd, 0.95) AS e, 100.0 * count(*) FILTER (low <= 750) / count(*) AS t75, 100.0 * count(*) FILTER (low <= 500) / count(*) AS t50, 100.0 * count(*) FILTER (low <= 200) / count(*) AS t20 FROM s GROUP BY 1)
SELECT strategy, sims, round(a, 6) AS pf_p5, round(b, 6) AS pf_p50, round(c, 6) AS pf_p95, round(d, 6) AS drawdown_p50, round(e, 6) AS drawdown_p95, round(t75, 6) AS touch_75, round(t50, 6) AS touch_50, round(t20, 6) AS touch_20, e < 40 AND t20 < 1 AS passed FROM g""", "trades")  # fmt: skip
def _(spark, d):
    return validation.path_summary(validation.resampled_paths(_trades(spark, d), SIMS, 1000.0))


@query("held_out", """WITH t AS (SELECT *, min(exit_time) OVER (PARTITION BY strategy) AS a, max(exit_time) OVER (PARTITION BY strategy) AS b FROM trades WHERE exit_time IS NOT NULL), p AS (SELECT *, CASE WHEN exit_time < a + (b - a) * 0.7 THEN 'train' ELSE 'test' END AS part FROM t), s AS (SELECT *, 1000.0 + sum(net_pl) OVER (PARTITION BY strategy, part ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS bal FROM p),
k AS (SELECT *, greatest(1000.0, max(bal) OVER (PARTITION BY strategy, part ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM s), g AS (SELECT strategy, part, count(*) AS trades, 100.0 * count(*) FILTER (net_pl > 0) / count(*) AS w, sum(greatest(net_pl, 0.0)) / nullif(sum(greatest(-net_pl, 0.0)), 0) AS pf, sum(net_pl) AS net, min(bal) AS low, max(100.0 * (peak - bal) / peak) AS dd FROM k GROUP BY 1, 2)
SELECT strategy, part, trades, round(w, 6) AS win_rate, round(pf, 6) AS profit_factor, round(net, 6) AS net_pl, round(low, 6) AS least_balance, round(dd, 6) AS drawdown_pct, coalesce(pf > 1.2, true) AND dd < 40 AND low >= 500 AS passed FROM g""", "trades")  # fmt: skip
def _(spark, d):
    return validation.held_out(_trades(spark, d), 0.7, 1000.0)
