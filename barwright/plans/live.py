"""Streaming operators replayed over the given events in several batches with a restart between, held to SQL over the whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.plans.market import CTE, hourly, query
from barwright.plans.series import _GAPS
from barwright.staging import folder, staged
from barwright.streaming import live

ROCKS, KEY = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"


def replayed(rows: DataFrame, time: str, make: Callable[[DataFrame], DataFrame], batches: int = 4) -> DataFrame:
    """What make() gives of a stream of rows: parts in order of time, one a batch; after each the query ends and starts again from its checkpoint.

    A part is as many files as it has partitions. Without a limit on files a query takes all that are new as one batch.
    """
    spark = rows.sparkSession
    at, rows = folder(spark, "replay"), staged(rows, "rows")
    cuts = rows.select(F.col(time).cast("long").alias("t")).approxQuantile("t", [k / batches for k in range(1, batches)], 0.001) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    before = spark.conf.get(KEY, None)
    spark.conf.set(KEY, ROCKS)
    rows.limit(0).coalesce(1).write.parquet(f"{at}/in")  # the folder must be there
    stream = make(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    try:
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = rows
            if lo is not None:
                part = part.where(F.col(time).cast("long") >= lo)
            if hi is not None:
                part = part.where(F.col(time).cast("long") < hi)
            part.write.mode("append").parquet(f"{at}/in")
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"t": F.unix_seconds("ts"), "seq": F.col("event_id")})


@query("stream_first_seen", """WITH n AS (SELECT user_id % 200 AS u, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, row_number() OVER (PARTITION BY user_id % 200, event_type ORDER BY ts, event_id) AS rn FROM events), m AS (SELECT *, (SELECT min(b.rn) FROM n b WHERE b.u = n.u AND b.event_type = n.event_type AND b.rn > n.rn AND b.t >= n.t + 7200) AS nxt FROM n),
r AS (SELECT * FROM m WHERE rn = 1 UNION ALL SELECT m.* FROM r JOIN m ON m.u = r.u AND m.event_type = r.event_type AND m.rn = r.nxt) SELECT t, event_id AS seq FROM r""".replace("WITH n", "WITH RECURSIVE n"))  # fmt: skip
def _(spark, d):
    e = _events(spark, d).withColumn("u", F.col("user_id") % 200)
    return replayed(e.select("ts", "t", "seq", "u", "event_type"), "ts", lambda s: live.first_seen(s, ["u", "event_type"], 7200)).select("t", "seq")


CTE["account"] = "SELECT symbol AS account, t, event_id AS seq, row_number() OVER w AS rn, 600.0 + sum(price - 50.0) OVER w AS balance, 600.0 + sum(price - 50.0) OVER w - event_id % 10 AS equity, CAST(event_id % 140 AS DOUBLE) AS margin, CASE WHEN event_id % 3 <> 0 THEN price - 50.0 END AS pl FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t, event_id)"
_D = "CAST(floor((n.t + 19800) / 86400) AS BIGINT)"
_RISK = f"""ar AS (SELECT n.*, {_D} AS day, {_D} - ({_D} + 3) % 7 AS week, CAST(year(make_timestamp((n.t + 19800) * 1000000)) * 12 + month(make_timestamp((n.t + 19800) * 1000000)) AS BIGINT) AS month FROM account n),
as0 AS (SELECT *, max(balance) OVER (PARTITION BY account ORDER BY rn) AS peak, first_value(balance) OVER (PARTITION BY account, day ORDER BY rn) AS db, first_value(balance) OVER (PARTITION BY account, week ORDER BY rn) AS wb, first_value(balance) OVER (PARTITION BY account, month ORDER BY rn) AS mb, count(*) FILTER (pl < 0) OVER (PARTITION BY account, day ORDER BY rn) AS losers,
sum(CASE WHEN pl >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY rn) AS island FROM ar),
as1 AS (SELECT *, count(*) FILTER (pl < 0) OVER (PARTITION BY account, island ORDER BY rn) AS streak FROM as0),
as2 AS (SELECT *, greatest(0, coalesce(max(CASE WHEN pl < 0 AND streak IN (3, 4) THEN t + 14400 END) OVER (PARTITION BY account ORDER BY rn), 0)) AS paused, coalesce(max(CASE WHEN pl < 0 AND streak >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY account, day ORDER BY rn), 0) = 1 AS stopped,
CASE WHEN peak > 0 AND (peak - equity) / peak >= 0.3 THEN 'peak' WHEN mb > 0 AND (mb - equity) / mb >= 0.25 THEN 'month' END AS kill FROM as1),
as3 AS (SELECT *, count(kill) OVER (PARTITION BY account ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS halted FROM as2)"""


@query("stream_risk_gate", f"""WITH {_RISK} SELECT account, t, seq, CASE WHEN halted THEN 'halted' WHEN kill IS NOT NULL THEN kill WHEN wb > 0 AND (wb - equity) / wb >= 0.15 THEN 'week' WHEN stopped THEN 'stopped' WHEN db > 0 AND (db - equity) / db >= CASE WHEN balance < 400 THEN 0.03 ELSE 0.06 END THEN 'day' WHEN balance < 400 AND losers >= 2 THEN 'losers' WHEN paused > t THEN 'paused' WHEN equity <= 0 OR margin / equity > 0.2 THEN 'margin' ELSE 'allowed' END AS reason,
losers AS day_losers, streak, round(greatest(peak, 0), 6) AS peak, CAST(paused AS BIGINT) AS paused_until FROM as3""", "account")  # fmt: skip
def _(spark, d):
    e = _events(spark, d)
    w = Window.partitionBy("event_type").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    balance = 600.0 + F.sum(F.col("value") - 50.0).over(w)
    rows = e.select("ts", F.col("event_type").alias("account"), "t", "seq", balance.alias("balance"), (balance - F.col("seq") % 10).alias("equity"), (F.col("seq") % 140).cast("double").alias("margin"), F.when(F.col("seq") % 3 != 0, F.col("value") - 50.0).alias("pl"))
    return replayed(rows, "ts", live.risk_gate)


@query("stream_tripwire", """WITH c AS (SELECT symbol AS account, t, event_id AS seq, price - 50.0 AS pl, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t, event_id)), f AS (SELECT *, CASE WHEN rn >= 30 THEN sum(greatest(pl, 0)) OVER v / nullif(sum(greatest(-pl, 0)) OVER v, 0) END AS f FROM c WINDOW v AS (PARTITION BY account ORDER BY rn ROWS 29 PRECEDING))
SELECT account, t, seq, round(f, 6) AS factor, CASE WHEN rn < 30 THEN 'early' WHEN f IS NULL OR f >= 1 THEN 'fine' WHEN f < 0.8 THEN 'stop' ELSE 'warn' END AS level FROM f""", "hours")  # fmt: skip
def _(spark, d):
    e = _events(spark, d).select("ts", F.col("event_type").alias("account"), "t", "seq", (F.col("value") - 50.0).alias("pl"))
    return replayed(e, "ts", live.tripwire)


@query("stream_gap_boxes", f"WITH {_GAPS} SELECT n.symbol, n.time, count(*) FILTER (x.side > 0) AS bulls, count(*) FILTER (x.side < 0) AS bears, round(max(x.top) FILTER (x.side > 0), 6) AS support, round(min(x.bottom) FILTER (x.side < 0), 6) AS resistance FROM sn n LEFT JOIN bx x ON x.symbol = n.symbol AND x.created <= n.bn AND (x.closed IS NULL OR x.closed > n.bn) GROUP BY 1, 2", "hours")
def _(spark, d):
    return replayed(hourly(spark, d).select("symbol", "time", "high", "low", "close"), "time", live.gap_boxes)


_SIDE = "CASE WHEN abs(close - open) > 0.6 * greatest(high - low, 1e-9) THEN CASE WHEN close > open THEN 1 ELSE -1 END ELSE 0 END"


@query("stream_confirmations", f"""WITH s AS (SELECT symbol, time, close, {_SIDE} AS side, lead(time) OVER w AS nt, lead(close) OVER w AS nc FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY time)), z AS (SELECT max(time) - 600 AS mark FROM hours)
SELECT symbol, time, CAST(side AS BIGINT) AS side, CASE WHEN nt IS NULL OR nt > time + 5400 THEN 'expired' WHEN side * (nc - close) > 0 THEN 'confirmed' ELSE 'dropped' END AS outcome, CASE WHEN nt IS NULL OR nt > time + 5400 THEN time + 5400 ELSE nt END AS at FROM s, z WHERE side <> 0 AND (nt IS NOT NULL OR time + 5400 <= mark)""", "hours")  # fmt: skip
def _(spark, d):
    side = F.when(F.abs(F.col("close") - F.col("open")) > 0.6 * F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)), F.when(F.col("close") > F.col("open"), 1).otherwise(-1)).otherwise(0)
    b = hourly(spark, d).select("symbol", "time", "close", side.cast("long").alias("side"), F.timestamp_seconds("time").alias("ts"))
    return replayed(b, "ts", lambda s: live.confirmed(s, 5400))


@query("stream_closes", """WITH o AS (SELECT user_id % 500 AS ticket, epoch_us(ts) AS m, event_id AS order_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id % 500 AS ticket, epoch_us(ts) AS m, event_id AS close_id FROM events WHERE event_type = 'purchase'),
z AS (SELECT least((SELECT max(m) FROM o), (SELECT max(m) FROM c)) - 600000000 AS mark) SELECT order_id, close_id FROM o LEFT JOIN c ON c.ticket = o.ticket AND c.m BETWEEN o.m AND o.m + 7200000000 CROSS JOIN z WHERE close_id IS NOT NULL OR o.m + 7200000000 < floor(mark / 1000) * 1000""")  # fmt: skip
def _(spark, d):
    e = _events(spark, d).select("ts", (F.col("user_id") % 500).alias("ticket"), "event_type", "seq")
    of = lambda s, kind, name: s.where(F.col("event_type") == kind).select("ticket", "ts", F.col("seq").alias(name))
    return replayed(e, "ts", lambda s: live.closes_of(of(s, "view", "order_id"), of(s, "purchase", "close_id")))
