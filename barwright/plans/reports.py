"""Queries on the candidates' registry, ratios, folds, execution prices and report levels, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import frames, levels, recurrences, registry, reports, rules
from barwright.plans.market import _ALL, _FEAT, _SIGS, SQL, hourly, query
from barwright.plans.portfolio import _OUT, _SUMS, START, _trades
from barwright.plans.research import _STATE
from barwright.staging import staged

#: First number and number of exits of each rule, as the registry is documented.
_NUMBERS = """('ema_stack', 1, 2), ('donchian_break', 7, 2), ('donchian_break_adx', 13, 1), ('pullback_ema20', 16, 2), ('momentum_roc', 22, 1), ('higher_high_structure', 25, 1), ('zscore_revert', 28, 2), ('bb_fade', 34, 2), ('rsi_extreme', 40, 2), ('atr_exhaustion', 46, 1), ('range_rejection', 49, 1),
('failed_breakout', 52, 2), ('vwap_revert', 58, 1), ('squeeze_break', 61, 1), ('atr_expansion', 64, 1), ('nr7_break', 67, 1), ('low_vol_revert', 70, 1), ('opening_break', 73, 2), ('session_sweep_revert', 79, 2), ('prev_day_level', 85, 1), ('displacement', 88, 1), ('fair_value_gap', 91, 1), ('fair_value_gap_macd', 94, 1),
('liquidity_sweep', 97, 2), ('break_retest', 103, 1), ('engulfing', 106, 1), ('inside_bar_break', 109, 1), ('ema_sar_full', 112, 2), ('ema_sar_simple', 118, 2), ('structure_break_choch', 124, 2), ('structure_break_bos', 130, 2), ('order_block', 136, 2)"""


def _indicators(spark, d) -> DataFrame:
    return recurrences.indicators(frames.candle_parts(hourly(spark, d)))


@query("candidate_signals", f"""WITH {_FEAT}, {_SIGS}{_STATE[len(_ALL):]}, every AS (SELECT symbol, time, rule, signal FROM sigs WHERE signal <> 0 UNION ALL SELECT symbol, time, rule, signal FROM ss WHERE signal <> 0),
reg AS (SELECT rule, 'XAU-' || lpad(CAST(first + exits * s + x AS VARCHAR), 3, '0') AS id, CASE WHEN s = 0 THEN 'LONDON' WHEN s = 1 THEN 'NY' WHEN rule = 'opening_break' THEN 'ASIA' ELSE 'ALL' END AS session, CASE WHEN x = 0 THEN 3.0 ELSE 1.5 END AS target FROM (VALUES {_NUMBERS}) v(rule, first, exits), range(3) a(s), range(2) b(x) WHERE x < exits),
hrs AS (SELECT *, ((time + 19800) % 86400) / 3600.0 AS h FROM every)
SELECT id, reg.rule, session, CAST(target AS DOUBLE) AS target, count(*) AS signals, count(*) FILTER (signal > 0) AS longs FROM hrs JOIN reg ON reg.rule = hrs.rule AND CASE session WHEN 'LONDON' THEN h >= 11.5 AND h < 15.5 WHEN 'NY' THEN h >= 17.5 AND h < 21.5 WHEN 'ASIA' THEN h >= 2.5 AND h < 11.5 ELSE h >= 11.5 AND h < 21.5 END GROUP BY 1, 2, 3, 4""", "hours", "candles")  # fmt: skip
def _(spark, d):
    b = staged(hourly(spark, d), "bars")
    s = rules.signals(rules.features(b)).unionByName(rules.signals(rules.state_features(b), rules.STATE_RULES))
    x = registry.candidate_signals(s, registry.candidates())
    return x.groupBy("id", "rule", "session", "target").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("signal") > 0).alias("longs"))


@query("trade_ratios", f"""WITH e AS (SELECT strategy, (exit_time - entry_time) / 60.0 AS m, net_pl FROM trades WHERE exit_time IS NOT NULL), s AS (SELECT strategy, avg(m) AS am, quantile_cont(m, 0.5) AS mm, sum(net_pl) / {START} * 100 AS ret, avg(net_pl) AS e, sum(net_pl) FILTER (net_pl > 0) AS g, -sum(net_pl) FILTER (net_pl < 0) AS l FROM e GROUP BY 1), d AS ({SQL["trade_drawdown"]})
SELECT s.strategy, round(am, 6) AS avg_minutes, round(mm, 6) AS median_minutes, round(ret, 6) AS return_pct, round(CASE WHEN drawdown_pct = 0 THEN 0.0 ELSE coalesce(e * 98280.0 / nullif(am, 0) / {START} * 100, ret) / drawdown_pct END, 3) AS calmar, round(CASE WHEN l > 0 THEN coalesce(g, 0) / l WHEN g IS NULL THEN 0.0 END, 6) AS omega FROM s JOIN d USING (strategy)""", "trades")  # fmt: skip
def _(spark, d):
    return reports.ratios(_trades(spark, d), START)


@query("period_results", f"WITH b AS (SELECT strategy, exit_time // 604800 AS period, {_SUMS} FROM trades WHERE exit_time IS NOT NULL GROUP BY 1, 2) SELECT strategy, CAST(period AS BIGINT) AS period, {_OUT} FROM b", "trades")
def _(spark, d):
    return reports.periods(_trades(spark, d), 604_800)


#: Begin, training and test time of the walk forward's folds.
_FOLDS = (1_704_067_200, 7 * 86_400, 2 * 86_400)


@query("walk_forward_folds", f"""WITH k AS (SELECT CAST(range AS INT) AS fold, {_FOLDS[0]} + range * {_FOLDS[2]} AS a, {_FOLDS[0]} + range * {_FOLDS[2]} + {_FOLDS[1]} AS b FROM range(2000)), x AS (SELECT fold, CASE WHEN entry_time < b THEN 'train' ELSE 'test' END AS part, net_pl FROM trades JOIN k ON entry_time >= a AND entry_time < b + {_FOLDS[2]}), g AS (SELECT fold, part, {_SUMS} FROM x GROUP BY 1, 2)
SELECT CAST(fold AS BIGINT) AS fold, part, {_OUT} FROM g""", "trades")  # fmt: skip
def _(spark, d):
    return reports.folds(_trades(spark, d), *_FOLDS)


@query("execution_prices", "WITH p AS (SELECT *, CASE WHEN tick_volume % 5 = 0 THEN 20 ELSE tick_volume % 5 END * 0.001 AS sp FROM hours) SELECT symbol, time, round(CAST(sp AS DOUBLE), 6) AS spread_price, round(close + sp, 6) AS ask, round(close, 6) AS bid, CAST(0.005 AS DOUBLE) AS slip, CAST(0.07 AS DOUBLE) AS commission, round(close * 100 * 0.01 / 500, 6) AS margin FROM p", "hours")
def _(spark, d):
    b = hourly(spark, d).withColumn("points", F.col("tick_volume") % 5)
    return reports.execution_prices(b, "points").select("symbol", "time", "spread_price", "ask", "bid", "slip", "commission", "margin")


@query("stop_levels", f"""WITH {_ALL}, x AS (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS side, ((time + 19800) % 86400) / 3600.0 AS h FROM ind WHERE atr14 > 0)
SELECT symbol, time, CAST(side AS BIGINT) AS side, round_even(close - side * CASE WHEN side < 0 THEN 1.0 WHEN h >= 11.5 AND h < 21.5 THEN 1.5 ELSE 2.0 END * atr14, 3) AS stop, round_even(close + side * CASE WHEN side < 0 THEN 2.0 ELSE 3.0 END * atr14, 3) AS target FROM x""", "hours", "candles")  # fmt: skip
def _(spark, d):
    x = levels.with_calendar(_indicators(spark, d)).where("atr14 > 0").withColumn("side", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    return reports.stop_levels(x, "side", strict_shorts=True).select("symbol", "time", "side", "stop", "target")


@query("random_rule", "WITH u AS (SELECT symbol, time, " + ", ".join(f"CAST(CAST('0x' || md5('random-{k}:' || symbol || ':' || time)[1:13] AS UBIGINT) AS DOUBLE) / {float(2**52)} AS {k}" for k in ("fires", "side")) + " FROM hours) SELECT symbol, time, CAST(CASE WHEN side < 0.5 THEN 1 ELSE -1 END AS BIGINT) AS signal FROM u WHERE fires < 0.1", "hours")
def _(spark, d):
    return reports.random_signals(hourly(spark, d), 0.1)


@query("bias_agreement", f"WITH {_ALL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM ind) SELECT symbol, count(ema20 + ema200) AS bars, count(*) FILTER ((close > ema20 AND close > ema200) OR (close <= ema20 AND close <= ema200)) AS agree FROM l WHERE back <= 60 GROUP BY 1", "hours", "candles")
def _(spark, d):
    return reports.bias_agreement(_indicators(spark, d))


@query("gap_filters", f"""WITH {_ALL}, g AS (SELECT i.*, low - lag(high, 2) OVER w AS gap_up, lag(low, 2) OVER w - high AS gap_down, lag(close) OVER w - lag(high, 2) OVER w AS cu, lag(low, 2) OVER w - lag(close) OVER w AS cd FROM ind i WINDOW w AS (PARTITION BY symbol ORDER BY time)),
f AS (SELECT symbol, time, CASE WHEN gap_down > 0 AND gap_down >= 0.02 * close THEN -1 WHEN gap_up > 0 AND gap_up >= 0.02 * close THEN 1 ELSE 0 END AS by_share, CASE WHEN gap_down > 0 AND gap_down >= 0.25 * atr14 THEN -1 WHEN gap_up > 0 AND gap_up >= 0.25 * atr14 THEN 1 ELSE 0 END AS by_range, CASE WHEN gap_down > 0 AND cd > 0 THEN -1 WHEN gap_up > 0 AND cu > 0 THEN 1 ELSE 0 END AS confirmed FROM g)
SELECT symbol, time, CAST(by_share AS BIGINT) AS by_share, CAST(by_range AS BIGINT) AS by_range, CAST(confirmed AS BIGINT) AS confirmed FROM f WHERE by_share <> 0 OR by_range <> 0 OR confirmed <> 0""", "hours", "candles")  # fmt: skip
def _(spark, d):
    return reports.gap_signals(_indicators(spark, d), 0.02, 0.25)


@query("session_widths", """WITH p AS (SELECT symbol, ist_day AS occurrence, max(high) - min(low) AS width FROM cal WHERE session = 'ASIA' GROUP BY 1, 2), q AS (SELECT * FROM (SELECT *, lag(width) OVER (PARTITION BY symbol ORDER BY occurrence) AS b FROM p) WHERE b IS NULL OR b <> width), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY occurrence) AS k FROM q)
SELECT a.symbol, a.occurrence, round(any_value(a.width), 6) AS width, round(CASE WHEN count(b.k) >= 5 THEN count(*) FILTER (b.width < a.width) / count(b.k) END, 6) AS narrower FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 20 AND a.k - 1 GROUP BY 1, 2""", "hours", "cal")  # fmt: skip
def _(spark, d):
    return reports.session_widths(levels.occurrences(levels.with_calendar(hourly(spark, d)), 2.5, 11.5))


@query("slot_ratio", f"""WITH {_ALL}, s AS (SELECT *, ((time + 19800) % 86400) // 3600 AS slot FROM ind), a AS (SELECT x.symbol, x.time, avg(y.atr14) AS m, avg(y.atr14) FILTER (y.slot = x.slot) AS o, count(y.atr14) FILTER (y.slot = x.slot) AS n FROM s x JOIN s y ON y.symbol = x.symbol AND y.time <= x.time GROUP BY 1, 2)
SELECT symbol, time, round(coalesce(CASE WHEN n >= 3 THEN o / nullif(m, 0) END, 1.0), 6) AS slot_ratio FROM a""", "hours", "candles")  # fmt: skip
def _(spark, d):
    return reports.slot_ratio(_indicators(spark, d)).select("symbol", "time", "slot_ratio")


@query("day_so_far", "SELECT a.symbol, a.time, round(max(b.high), 6) AS day_high, round(min(b.low), 6) AS day_low FROM cal a LEFT JOIN cal b ON b.symbol = a.symbol AND b.ist_day = a.ist_day AND b.time < a.time GROUP BY 1, 2", "hours", "cal")
def _(spark, d):
    return reports.day_so_far(levels.with_calendar(hourly(spark, d))).select("symbol", "time", "day_high", "day_low")


@query("median_range", f"WITH {_ALL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM ind WHERE atr14 IS NOT NULL) SELECT a.symbol, a.time, round(median(b.atr14), 6) AS median_range FROM n a JOIN n b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 99 AND a.k GROUP BY 1, 2 HAVING count(*) = 100", "hours", "candles")
def _(spark, d):
    return reports.median_range(_indicators(spark, d)).where("median_range IS NOT NULL").select("symbol", "time", "median_range")
