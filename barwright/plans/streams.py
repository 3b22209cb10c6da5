"""Streaming operators run to the end of a file stream; what they wrote is read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans.live import replayed
from barwright.plans.market import query
from barwright.staging import folder
from barwright.streaming.bars import closed_bars, cooled
from barwright.streaming.live import first_seen


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, provider: str | None = None) -> DataFrame:
    """Everything that a stream gives until its source is read up."""
    spark = stream.sparkSession
    at = folder(spark, "stream")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if provider:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("stream_closed_bars", """WITH e AS (SELECT (SELECT max(micros) FROM ticks) AS m) SELECT symbol, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_volume FROM hours, e WHERE (time + 3600) * 1000000 <= CAST(floor((m - 600000000) / 1000) * 1000 AS BIGINT)""", "hours")
def _(spark, d):
    ticks = event_stream(spark, d).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    return drained(closed_bars(ticks))


@query("stream_deduplicated", """WITH RECURSIVE n AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events), m AS (SELECT *, (SELECT min(b.rn) FROM n b WHERE b.user_id = n.user_id AND b.event_type = n.event_type AND b.t >= n.t + 7200) AS nxt FROM n),
r AS (SELECT * FROM m WHERE rn = 1 UNION ALL SELECT m.* FROM r JOIN m ON m.user_id = r.user_id AND m.event_type = r.event_type AND m.rn = r.nxt) SELECT user_id, event_type, t, event_id FROM r""")  # fmt: skip
def _(spark, d):
    # keys expire after two hours; rows come in several batches with a restart between
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("ts", F.unix_seconds("ts").alias("t"), F.col("event_id").alias("seq"), "user_id", "event_type")
    passed = replayed(e, "ts", lambda s: first_seen(s, ["user_id", "event_type"], 7200))
    key = F.split("key", "\x1f")
    return passed.select(key[0].cast("long").alias("user_id"), key[1].alias("event_type"), "t", F.col("seq").alias("event_id"))


@query("stream_cooldown", """WITH n AS (SELECT symbol, t, event_id, row_number() OVER (PARTITION BY symbol ORDER BY t, event_id) AS rn FROM ticks), r AS (SELECT symbol, t, event_id, rn FROM n WHERE rn = 1 UNION ALL SELECT x.symbol, x.t, x.event_id, x.rn FROM r, LATERAL (SELECT * FROM n WHERE n.symbol = r.symbol AND n.rn > r.rn AND n.t >= r.t + 2700 ORDER BY n.rn LIMIT 1) x)
SELECT symbol AS strategy, t, event_id FROM r""", "hours")  # fmt: skip
def _(spark, d):
    s = event_stream(spark, d).select(F.col("event_type").alias("strategy"), F.unix_seconds("ts").alias("t"), "event_id")
    return drained(cooled(s), "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
