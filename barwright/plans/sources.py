"""Queries that go through written calendars and reports, read back, with DuckDB's SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.plans.market import CTE, hourly, query
from barwright.plans.portfolio import _trades
from barwright.plans.series import HELD, RISK
from barwright.sources import news, reports
from barwright.sources.market import ticks
from barwright.staging import folder

_STAMP = "strftime(date_trunc('minute', ts), '%Y-%m-%d') AS date, strftime(date_trunc('minute', ts), '%H:%M') AS utc_time"
# one calendar of errors, and one of signups that overlaps it; names of a minute are in order
CTE["base_events"] = f"SELECT {_STAMP}, 'error ' || user_id % 10 AS name, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY 'error ' || user_id % 10, strftime(ts, '%H:%M'), event_id) - 1 AS place FROM events WHERE event_type = 'error'"
CTE["more_events"] = f"SELECT {_STAMP}, 'signup ' || user_id % 7 AS name, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY 'signup ' || user_id % 7, strftime(ts, '%H:%M'), event_id) - 1 AS place FROM events WHERE event_type = 'signup'"
CTE["agenda"] = "SELECT *, CAST(epoch(CAST(date || ' ' || utc_time AS TIMESTAMP)) AS BIGINT) AS due FROM (SELECT *, 0 AS later FROM base_events UNION ALL SELECT *, 1 FROM more_events m WHERE NOT EXISTS (SELECT 1 FROM base_events b WHERE b.date = m.date AND b.utc_time = m.utc_time))"
_USES = ("base_events", "more_events", "agenda")


def _agenda(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    at = folder(spark, "calendar")
    for kind, n in (("error", 10), ("signup", 7)):
        own = e.where(F.col("event_type") == kind)
        name = F.concat_ws(" ", F.lit(kind), (F.col("user_id") % n).cast("string"))
        news.write_calendar(own.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), name.alias("name"), F.date_format("ts", "HH:mm").alias("utc_time")), f"{at}/{kind}")
    return news.scheduled(news.merged(news.read_calendar(spark, f"{at}/error"), news.read_calendar(spark, f"{at}/signup")))


@query("news_agenda", "SELECT date, utc_time, name, place, CAST(later AS BIGINT) AS later, due FROM agenda", *_USES)
def _(spark, d):
    return _agenda(spark, d).select("date", "utc_time", "name", F.col("place").cast("long").alias("place"), "later", "due")


_POINTS = "pt AS (SELECT DISTINCT time FROM hours)"


@query("news_blackout", f"""WITH {_POINTS}, n AS (SELECT time, name, due FROM pt JOIN agenda ON due BETWEEN time - 300 AND time + 300 QUALIFY row_number() OVER (PARTITION BY time ORDER BY date, later, place, name) = 1)
SELECT pt.time, name, CAST(round(abs(pt.time - due) / 60.0) AS BIGINT) AS minutes_off, CASE WHEN pt.time < due THEN 'before' WHEN due IS NOT NULL THEN 'after' END AS direction FROM pt LEFT JOIN n ON n.time = pt.time""", "hours", *_USES)  # fmt: skip
def _(spark, d):
    return news.blackout(hourly(spark, d).select("time").distinct(), _agenda(spark, d), "time", 5)


@query("news_upcoming", f"WITH {_POINTS} SELECT time, name, date, utc_time, CAST(floor((due - time) / 60) AS BIGINT) AS minutes_away, row_number() OVER (PARTITION BY time ORDER BY due, date, later, place, name) AS nth FROM pt JOIN agenda ON due BETWEEN time AND time + 14400", "hours", *_USES)
def _(spark, d):
    return news.upcoming(hourly(spark, d).select("time").distinct(), _agenda(spark, d), "time", 4.0)


def _held(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("micros", "event_id")
    t = ticks(spark, d)
    x = t.select(F.col("event_id").alias("trade_id"), F.col("symbol").alias("strategy"), (F.col("event_id") % 2 == 0).alias("is_buy"), F.col("t").alias("entry_time"), F.col("price").alias("entry_price"), F.lead("t", HELD).over(w).alias("exit_time"), F.lead("price", HELD).over(w).alias("exit_price"))
    x = x.where("exit_time IS NOT NULL").withColumn("net_pl", F.when(F.col("is_buy"), 1).otherwise(-1) * (F.col("exit_price") - F.col("entry_price")))
    return x.withColumns({"exit_reason": F.when(F.col("trade_id") % 3 == 0, "target").otherwise("stop"), "risk": F.when(F.col("trade_id") % 10 == 0, 0.0).otherwise(RISK)})


_OUT = f"""o AS (SELECT *, (CASE WHEN is_buy THEN 1 ELSE -1 END) * (exit_price - entry_price) AS net_pl FROM held WHERE exit_time IS NOT NULL)"""
_PIPS = "round(CASE WHEN CASE WHEN is_buy THEN net_pl > 0 ELSE net_pl >= 0 END THEN 1 ELSE -1 END * abs(exit_price - entry_price) / 0.01, 1) + 0.0"


@query("report_trades", f"""WITH {_OUT} SELECT trade_id, strftime(make_timestamp(entry_time * 1000000), '%Y-%m-%d %H:%M:%S') AS entry_datetime, CASE WHEN is_buy THEN 'BUY' ELSE 'SELL' END AS direction, round(net_pl, 2) + 0.0 AS net_pl, {_PIPS} AS pips, CASE WHEN trade_id % 3 = 0 THEN 'target' ELSE 'stop' END AS exit_reason, round((exit_time - entry_time) / 60.0, 1) AS duration_minutes, CASE WHEN net_pl > 0 THEN 'WIN' WHEN net_pl < 0 THEN 'LOSS' ELSE 'SCRATCH' END AS trade_result, CAST(sign(net_pl) AS DOUBLE) AS return_r, CASE WHEN is_buy THEN 'buys' ELSE 'sells' END AS run FROM o""", "held")
def _(spark, d):
    # three writes: one run, another, and the first again in its final form; what is read back are both runs' last forms
    t, at = _held(spark, d), folder(spark, "report")
    for run, rows in (("buys", t.where("is_buy").limit(5)), ("sells", t.where("NOT is_buy")), ("buys", t.where("is_buy"))):
        reports.write_trades(reports.derived(rows), at, run)
    return reports.read_trades(spark, at).select("trade_id", "entry_datetime", "direction", "net_pl", "pips", "exit_reason", "duration_minutes", "trade_result", "return_r", "run")


@query("report_series", f"""WITH {_OUT}, s AS (SELECT entry_time, exit_time, net_pl FROM o WHERE trade_id % 10 <> 0) SELECT entry_time, count(*) AS n, max(exit_time) AS exit_time, round(sum(net_pl), 6) AS net_pl, round(sum(net_pl / {RISK}), 6) AS r FROM s GROUP BY 1""", "held")
def _(spark, d):
    at = folder(spark, "series")
    reports.write_series(_held(spark, d), at)
    s = reports.read_series(spark, at)
    return s.groupBy("entry_time").agg(F.count(F.lit(1)).alias("n"), F.max("exit_time").alias("exit_time"), F.sum("net_pl").alias("net_pl"), F.sum("r").alias("r"))


@query("report_manifests", "SELECT strategy AS run, strategy AS setting, count(*) AS trades, min(entry_time) AS first, max(exit_time) AS last, round(sum(net_pl), 6) AS net_pl FROM trades WHERE exit_time IS NOT NULL GROUP BY 1", "trades")
def _(spark, d):
    t, at = _trades(spark, d).where("exit_time IS NOT NULL"), folder(spark, "manifests")
    # a run for each strategy; the strategies are the few event types
    for (name,) in t.select("strategy").distinct().orderBy("strategy").collect():
        reports.write_manifest(t.where(F.col("strategy") == name), at, name, {"strategy": name})
    return reports.read_manifests(spark, at).select("run", F.col("settings")["strategy"].alias("setting"), "trades", "first", "last", "net_pl")
