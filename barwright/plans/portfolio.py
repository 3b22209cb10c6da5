"""Queries on trades, resampling and the event log, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import calendar as cal
from barwright.operators import gates, inference
from barwright.operators import trades as tr
from barwright.plans.market import CTE, hourly, query
from barwright.sources.market import ticks

START = 10_000.0
_H = "((t + 19800) % 86400) / 3600.0"
CTE["trades"] = (
    "SELECT event_id AS trade_id, symbol AS strategy, event_id % 2 = 0 AS is_buy, t AS entry_time, lead(t) OVER (PARTITION BY symbol ORDER BY micros) AS exit_time, "
    f"CASE WHEN {_H} >= 2.5 AND {_H} < 11.5 THEN 'ASIA' WHEN {_H} >= 11.5 AND {_H} < 15.5 THEN 'LONDON' WHEN {_H} >= 15.5 AND {_H} < 17.5 THEN 'OVERLAP' WHEN {_H} >= 17.5 AND {_H} < 21.5 THEN 'NY' ELSE 'LATE' END AS session, "
    "price - 50.0 AS net_pl, (price - 50.0) / 25.0 AS r FROM ticks"
)
_SUMS = "count(*) AS trades, count(*) FILTER (net_pl > 0) AS wins, sum(net_pl) AS net_pl, sum(CASE WHEN net_pl > 0 THEN net_pl ELSE 0.0 END) AS gross_profit, sum(CASE WHEN net_pl > 0 THEN 0.0 ELSE abs(net_pl) END) AS gross_loss"
_OUT = "trades, wins, round(net_pl, 6) AS net_pl, round(gross_profit, 6) AS gross_profit, round(gross_loss, 6) AS gross_loss, round(100.0 * wins / trades, 6) AS win_rate, round(CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN NULL ELSE 0.0 END, 6) AS profit_factor"


def _trades(spark, d) -> DataFrame:
    return tr.trades_of(ticks(spark, d))


def _bucket_sql(keys: str, source: str = "trades") -> str:
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split("; "))
    return f"WITH b AS (SELECT {keys.replace('; ', ', ')}, {_SUMS} FROM {source} GROUP BY ALL) SELECT {names}, {_OUT} FROM b"


@query("trades_by_session", _bucket_sql("session"), "trades")
def _(spark, d):
    return tr.buckets(_trades(spark, d), "session")


@query("trades_by_strategy_side", _bucket_sql("strategy; is_buy"), "trades")
def _(spark, d):
    return tr.buckets(_trades(spark, d), "strategy", "is_buy")


@query("trades_by_month", _bucket_sql("strftime(make_timestamp((exit_time + 19800) * 1000000), '%Y-%m') AS month"), "trades")
def _(spark, d):
    return tr.buckets(_trades(spark, d), cal.month_ist(F.col("exit_time")).alias("month"))


@query("lineitem_buckets", _bucket_sql("strategy", "(SELECT l_returnflag || l_linestatus AS strategy, l_extendedprice * (1 - l_discount) - 50000.0 AS net_pl FROM lineitem)").replace(", 6)", ", 2)"))
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    t = li.select(F.concat("l_returnflag", "l_linestatus").alias("strategy"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 50000.0).alias("net_pl"))
    b = tr.buckets(t, "strategy")
    return b.select("strategy", "trades", "wins", *[F.round(c, 2).alias(c) for c in ("net_pl", "gross_profit", "gross_loss", "win_rate", "profit_factor")])


_SUMMARY = """WITH s AS (SELECT strategy, count(*) AS trades, count(*) FILTER (net_pl > 0) AS wins, count(*) FILTER (net_pl < 0) AS losses, count(*) FILTER (net_pl = 0) AS scratches, sum(net_pl) AS net_pl, coalesce(sum(net_pl) FILTER (net_pl > 0), 0) AS gross_profit, coalesce(sum(-net_pl) FILTER (net_pl < 0), 0) AS gross_loss, avg(net_pl) AS expectancy,
avg(net_pl) FILTER (net_pl > 0) AS avg_win, avg(-net_pl) FILTER (net_pl < 0) AS avg_loss, quantile_cont(net_pl, 0.5) FILTER (net_pl > 0) AS median_win, quantile_cont(-net_pl, 0.5) FILTER (net_pl < 0) AS median_loss, sum(r) AS total_r, avg(r) AS expectancy_r, stddev_pop(net_pl) FILTER (net_pl < 0) AS downside FROM trades GROUP BY 1)
SELECT strategy, trades, wins, losses, scratches, round(net_pl, 6) AS net_pl, round(gross_profit, 6) AS gross_profit, round(gross_loss, 6) AS gross_loss, round(expectancy, 6) AS expectancy, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(median_win, 6) AS median_win, round(median_loss, 6) AS median_loss, round(total_r, 6) AS total_r, round(expectancy_r, 6) AS expectancy_r,
round(100.0 * wins / trades, 6) AS win_rate, round(gross_profit / gross_loss, 6) AS profit_factor, round(avg_win / avg_loss, 6) AS payoff, round(100.0 * avg_loss / (avg_win + avg_loss), 6) AS breakeven, round(expectancy / downside, 6) AS sortino FROM s"""


@query("trade_summary", _SUMMARY, "trades")
def _(spark, d):
    return tr.summary(_trades(spark, d), "strategy")


@query("trade_drawdown", """WITH t AS (SELECT strategy, trade_id, exit_time, net_pl, row_number() OVER (PARTITION BY strategy ORDER BY exit_time, trade_id) AS rn, min(entry_time) OVER (PARTITION BY strategy) AS began FROM trades WHERE exit_time IS NOT NULL),
r AS (SELECT strategy, CAST(0 AS BIGINT) AS rn, CAST(10000.0 AS DOUBLE) AS balance, CAST(10000.0 AS DOUBLE) AS peak, began AS pt, began AS tm, CAST(0.0 AS DOUBLE) AS net FROM (SELECT DISTINCT strategy, began FROM t) UNION ALL SELECT t.strategy, t.rn, r.balance + t.net_pl, greatest(r.peak, r.balance + t.net_pl), CASE WHEN r.balance + t.net_pl > r.peak THEN t.exit_time ELSE r.pt END, t.exit_time AS tm, r.net + t.net_pl FROM r JOIN t ON t.strategy = r.strategy AND t.rn = r.rn + 1)
SELECT strategy, round(max(peak - balance), 6) AS max_drawdown, round(arg_max(100.0 * (peak - balance) / peak, (peak - balance, -tm)), 6) AS drawdown_pct, round(max((tm - pt) / 86400.0), 6) AS longest_days, round(arg_max(balance, rn), 6) AS end_balance, round(max(net) FILTER (rn = n) / max(peak - balance), 6) AS recovery FROM (SELECT *, max(rn) OVER (PARTITION BY strategy) AS n FROM r) GROUP BY 1""", "trades")  # fmt: skip
def _(spark, d):
    return tr.drawdown(_trades(spark, d), START)


@query("trade_streaks", """WITH t AS (SELECT *, net_pl > 0 AS won, row_number() OVER (PARTITION BY strategy ORDER BY entry_time, trade_id) - row_number() OVER (PARTITION BY strategy, net_pl > 0 ORDER BY entry_time, trade_id) AS island FROM trades WHERE net_pl <> 0), r AS (SELECT strategy, won, island, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT strategy, max(n) FILTER (won) AS max_wins, max(n) FILTER (NOT won) AS max_losses FROM r GROUP BY 1""", "trades")  # fmt: skip
def _(spark, d):
    return tr.streaks(_trades(spark, d))


@query("without_outliers", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY net_pl DESC, trade_id) AS b, row_number() OVER (PARTITION BY strategy ORDER BY net_pl, trade_id) AS w FROM trades) SELECT strategy, round(sum(net_pl), 6) AS net_pl, " + ", ".join(f"round(sum(net_pl) FILTER (b > {k}), 6) AS without_best_{k}, round(sum(net_pl) FILTER (w > {k}), 6) AS without_worst_{k}" for k in (1, 3, 5)) + " FROM t GROUP BY 1", "trades")
def _(spark, d):
    return tr.without_outliers(_trades(spark, d))


@query("daily_results", "WITH g AS (SELECT CAST(floor((exit_time + 19800) / 86400) AS BIGINT) AS day, count(*) AS trades, sum(net_pl) AS net_pl FROM trades WHERE exit_time IS NOT NULL GROUP BY 1) SELECT day, trades, round(net_pl, 6) AS net_pl, round(10000.0 + sum(net_pl) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS balance FROM g", "trades")
def _(spark, d):
    return tr.daily(_trades(spark, d), START)


@query("rolling_factor", f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_time DESC, trade_id DESC) AS rn FROM trades), b AS (SELECT strategy, {_SUMS} FROM l WHERE rn <= 30 GROUP BY 1), c AS (SELECT strategy, {_OUT} FROM b) SELECT strategy, trades, CASE WHEN trades >= 30 THEN profit_factor END AS profit_factor, CASE WHEN trades < 30 THEN NULL WHEN profit_factor < 0.8 THEN 'halt' WHEN profit_factor < 1.0 THEN 'warn' ELSE 'ok' END AS tripwire FROM c", "trades")
def _(spark, d):
    return tr.rolling_factor(_trades(spark, d))


@query("leave_one_out", f"WITH b AS (SELECT strategy, {_SUMS} FROM trades GROUP BY 1) SELECT strategy, CAST(sum(trades) OVER () - trades AS BIGINT) AS other_trades, round(sum(net_pl) OVER () - net_pl, 6) AS other_net_pl, round(sum(gross_profit) OVER () - gross_profit, 6) AS other_gross_profit, round(sum(gross_loss) OVER () - gross_loss, 6) AS other_gross_loss FROM b", "trades")
def _(spark, d):
    return tr.leave_one_out(_trades(spark, d))


@query("composite_ranking", f"WITH b AS (SELECT strategy, {_SUMS} FROM trades GROUP BY 1), c AS (SELECT strategy, 0.3 * (gross_profit / gross_loss) / max(gross_profit / gross_loss) OVER () + 0.3 * (100.0 * wins / trades) / max(100.0 * wins / trades) OVER () + 0.2 * gross_profit / max(gross_profit) OVER () + 0.2 * trades / max(trades) OVER () AS score FROM b) SELECT strategy, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, strategy) AS BIGINT) AS place FROM c", "trades")
def _(spark, d):
    return tr.composite(_trades(spark, d))


@query("regime_groups", f"WITH l AS (SELECT *, unnest([{{'kind': 'session', 'label': session}}, {{'kind': 'side', 'label': CASE WHEN is_buy THEN 'buy' ELSE 'sell' END}}]) AS x FROM trades), b AS (SELECT x.kind AS kind, x.label AS label, {_SUMS} FROM l GROUP BY 1, 2) SELECT kind, label, {_OUT} FROM b", "trades")
def _(spark, d):
    t = _trades(spark, d)
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("label"))
    labels = t.select("trade_id", F.array(pair("session", F.col("session")), pair("side", F.when(F.col("is_buy"), "buy").otherwise("sell"))).alias("labels"))
    return tr.regimes(t, labels)


@query("delay_penalty", f"WITH p AS (SELECT strategy, delay, net_pl - penalty AS net_pl FROM trades, (VALUES ('none', 0.0), ('short', 0.5), ('long', 2.0)) v(delay, penalty)), b AS (SELECT strategy, delay, {_SUMS} FROM p GROUP BY 1, 2) SELECT strategy, delay, {_OUT} FROM b", "trades")
def _(spark, d):
    return tr.delay_penalty(_trades(spark, d), [("none", 0.0), ("short", 0.5), ("long", 2.0)])


@query("reports_compared", f"WITH a AS (SELECT strategy, {_SUMS} FROM trades WHERE is_buy GROUP BY 1), b AS (SELECT strategy, {_SUMS} FROM trades WHERE NOT is_buy GROUP BY 1) SELECT coalesce(a.strategy, b.strategy) AS metric, round(a.net_pl, 6) AS a, round(b.net_pl, 6) AS b, CASE WHEN a.net_pl = b.net_pl THEN 'tie' WHEN b.net_pl IS NULL OR a.net_pl > b.net_pl THEN 'a' ELSE 'b' END AS better FROM a FULL JOIN b USING (strategy)", "trades")
def _(spark, d):
    t = _trades(spark, d)
    side = lambda c: tr.buckets(t.where(c), "strategy").select(F.col("strategy").alias("metric"), F.col("net_pl").alias("value"))
    return tr.compared(side(F.col("is_buy")), side(~F.col("is_buy")))


SIMS = 5000


def _hash_sql(first: str, sim: str, rest: str) -> str:
    """A chain of SELECTs that ends in h, 32 bits of trade_id and the simulation."""
    out = f"SELECT {rest}, xor(((trade_id % 2147483647) * 1103515245 + 12345) % 2147483648, (CAST({sim} AS BIGINT) * 69069 + 362437) % 2147483648) AS h FROM {first}"
    for a, c, shift in ((1664525, 1013904223, 15), (22695477, 1, 13), (1103515245, 12345, 16)):
        out = f"SELECT {rest}, xor(g, g >> {shift}) AS h FROM (SELECT {rest}, (h * {a} + {c}) % 4294967296 AS g FROM ({out}))"
    return out


_TIMES = " + ".join(f"CASE WHEN h >= {p * 2**32!r} THEN 1 ELSE 0 END" for p in inference.POISSON)
_BOOT = f"""WITH d AS (SELECT strategy, sim, net_pl, {_TIMES} AS k FROM ({_hash_sql(f"trades, range({SIMS}) r(sim)", "sim", "strategy, sim, net_pl, trade_id")})),
b AS (SELECT strategy, sim, sum(k * net_pl) / sum(k) AS e, sum(k * greatest(net_pl, 0.0)) AS g, sum(k * greatest(-net_pl, 0.0)) AS l FROM d GROUP BY 1, 2)"""


@query("bootstrap", f"{_BOOT} SELECT strategy, sim, round(e, 9) AS drawn_mean, round(g / l, 6) AS profit_factor FROM b", "trades")
def _(spark, d):
    return inference.bootstrap(_trades(spark, d), SIMS).withColumnRenamed("expectancy", "drawn_mean")


@query("bootstrap_intervals", f"{_BOOT} SELECT strategy, " + ", ".join(f"round(quantile_cont({x}, {q}), 6) AS {name}_p{round(q * 100):02d}" for name, x in (("expectancy", "e"), ("profit_factor", "g / l")) for q in (0.05, 0.5, 0.95)) + " FROM b GROUP BY 1", "trades")
def _(spark, d):
    return inference.interval(inference.bootstrap(_trades(spark, d), SIMS))


@query("shuffled_drawdown", f"""WITH s AS ({_hash_sql(f"trades, range({SIMS}) r(sim)", "sim", "strategy, sim, net_pl, trade_id")}), b AS (SELECT strategy, sim, h, trade_id, 1000.0 + sum(net_pl) OVER w AS balance FROM s WINDOW w AS (PARTITION BY strategy, sim ORDER BY h, trade_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT strategy, sim, balance, greatest(1000.0, max(balance) OVER w) - balance AS fall FROM b WINDOW w AS (PARTITION BY strategy, sim ORDER BY h, trade_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT strategy, sim, max(fall) AS dd, min(balance) AS low FROM f GROUP BY 1, 2)
SELECT strategy, round(quantile_cont(dd, 0.5), 6) AS drawdown_p50, round(quantile_cont(dd, 0.95), 6) AS drawdown_p95, round(avg(CASE WHEN low <= 0 THEN 1.0 ELSE 0.0 END), 6) AS ruin FROM p GROUP BY 1""", "trades")  # fmt: skip
def _(spark, d):
    return inference.shuffled_drawdown(_trades(spark, d), SIMS, 1000.0)


#: Student's tail by its finite series for whole degrees of freedom.
_TAIL = """CASE WHEN v % 2 = 0 THEN sin(a) * list_sum(list_transform(range(v // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + 2 * k * ln(cos(a))) / sqrt(pi())))
ELSE 2 / pi() * (a + sin(a) * cos(a) * coalesce(list_sum(list_transform(range((v - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 2 * k * ln(cos(a))) * sqrt(pi()) / 2)), 0)) END"""


@query("mean_tests", f"WITH m AS (SELECT strategy, count(r) AS n, avg(r) / stddev_pop(r) * sqrt(count(r)) AS t FROM trades GROUP BY 1), x AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS a FROM m), y AS (SELECT *, (1 - {_TAIL}) / 2 AS half FROM x), z AS (SELECT *, CASE WHEN t >= 0 THEN half ELSE 1 - half END AS p FROM y) SELECT strategy, n, round(t, 6) AS t, round(p, 6) AS p, round(least(1.0, p * 5), 6) AS corrected FROM z", "trades")
def _(spark, d):
    return inference.mean_tests(_trades(spark, d), 5)


@query("result_moments", "SELECT strategy, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5), 6) AS skew, round(avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2), 6) AS kurt FROM (SELECT strategy, r, avg(r) OVER (PARTITION BY strategy) AS m FROM trades) GROUP BY 1", "trades")
def _(spark, d):
    return inference.moments(_trades(spark, d))


@query("deflated_sharpe", """WITH m AS (SELECT strategy, count(r) AS n, avg(r) AS m, stddev_pop(r) AS s, avg(pow(r - a, 3)) / pow(avg(pow(r - a, 2)), 1.5) AS g, avg(pow(r - a, 4)) / pow(avg(pow(r - a, 2)), 2) AS k FROM (SELECT strategy, r, avg(r) OVER (PARTITION BY strategy) AS a FROM trades) GROUP BY 1),
z AS (SELECT strategy, m / s AS sr, {best} AS b, (m / s - {best}) * sqrt(n - 1) / sqrt(1 - g * (m / s) + (k - 1) / 4 * pow(m / s, 2)) AS z FROM m WHERE n >= 3 AND s > 0),
p AS (SELECT *, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(120), lambda i: exp((2 * i + 1) * ln(abs(z)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)))) AS up FROM z)
SELECT strategy, round(sr, 6) AS sharpe, round(b, 6) AS expected_best, round(CASE WHEN abs(z) > 8 THEN CASE WHEN z < 0 THEN 0.0 ELSE 1.0 END WHEN z < 0 THEN 1 - up ELSE up END, 6) AS deflated FROM p""".replace("{best}", f"({inference.expected_best(322, 0.02)!r})"), "trades")  # fmt: skip
def _(spark, d):
    return inference.deflated_sharpe(inference.moments(_trades(spark, d)), 322, 0.02)


@query("effective_trials", None)
def _(spark, d):
    # eigenvalues have no SQL: tests hold the figure to known matrices
    h = hourly(spark, d)
    names = sorted(r[0] for r in h.select("symbol").distinct().collect())
    wide = h.withColumn("r", F.col("close") - F.col("open")).groupBy("time").pivot("symbol", names).agg(F.first("r"))
    return spark.createDataFrame([(len(names), inference.effective_trials(wide, names))], "strategies long, effective double")


@query("order_close_pairs", """WITH o AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, max_by(event_id, ts) AS close_id, max(ts) AS cts FROM events WHERE event_type = 'purchase' GROUP BY 1), f AS (SELECT user_id, max_by(event_id, ts) AS order_id FROM o GROUP BY 1)
SELECT f.user_id, order_id, coalesce(close_id, -1) AS close_id FROM f LEFT JOIN c USING (user_id)""")  # fmt: skip
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    last = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("event_id", "ts").alias(name))
    return last("view", "order_id").join(last("purchase", "close_id"), "user_id", "left").withColumn("close_id", F.coalesce("close_id", F.lit(-1).cast("long")))


@query("never_closed", "SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND floor(epoch(b.ts) / 86400) = floor(epoch(a.ts) / 86400))")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).cast("long").alias("day")).distinct()
    return of("view").join(of("purchase"), ["user_id", "day"], "left_anti")


@query("candle_winner", "WITH x AS (SELECT *, CASE symbol WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS rank FROM hours), y AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY rank DESC, symbol) AS rn FROM x) SELECT time, symbol, CAST(rank AS BIGINT) AS rank FROM y WHERE rn = 1", "hours")
def _(spark, d):
    rank = F.create_map(F.lit("purchase"), F.lit(3), F.lit("click"), F.lit(2))[F.col("symbol")]
    x = hourly(spark, d).withColumn("rank", F.coalesce(rank, F.lit(1)))
    w = Window.partitionBy("time").orderBy(F.desc("rank"), "symbol")
    return x.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("time", "symbol", "rank")


@query("log_payloads", "SELECT event_type AS kind, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS most FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("log_dedupe", "SELECT user_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400).cast("long")
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type", day.alias("day")).agg(F.min("event_id").alias("event_id"))


_DAY_LOSS = "SELECT trade_id, round(coalesce((SELECT sum(e.net_pl) FROM trades e WHERE e.strategy = t.strategy AND e.exit_time <= t.entry_time AND floor((e.exit_time + 19800) / 86400) = floor((t.entry_time + 19800) / 86400)), 0.0), 6) AS day_loss FROM trades t"


@query("daily_breaker", f"WITH x AS ({_DAY_LOSS}) SELECT trade_id, day_loss, day_loss <= -60 AS stopped FROM x", "trades")
def _(spark, d):
    t = gates.daily_breaker(_trades(spark, d), 60.0)
    return t.select("trade_id", F.round("day_loss", 6).alias("day_loss"), (F.round("day_loss", 6) <= -60).alias("stopped"))


@query("exit_kinds", "SELECT strategy, CASE WHEN net_pl > 25 THEN 'target' WHEN net_pl < -25 THEN 'stop' ELSE 'time' END AS reason, count(*) AS trades, round(sum(net_pl), 6) AS net_pl FROM trades GROUP BY ALL", "trades")
def _(spark, d):
    reason = F.when(F.col("net_pl") > 25, "target").when(F.col("net_pl") < -25, "stop").otherwise("time")
    return _trades(spark, d).groupBy("strategy", reason.alias("reason")).agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pl").alias("net_pl"))
