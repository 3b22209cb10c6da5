"""Ticks and bars: readers, an on-disk bar cache with a manifest, and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, time long, open double, high double, low double, close double, tick_volume long"
LOG_SCHEMA = "ts long, ist string, kind string, strategy string, ticket long, profit double, reason string"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: symbol, event_id, t (epoch seconds), micros, price, volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_type").alias("symbol"), "event_id", F.unix_seconds(ts).alias("t"), F.unix_micros(ts).alias("micros"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"))


def write_bars(bars: DataFrame, path: str) -> None:
    """A cache partitioned by symbol, and a manifest of counts and a hash that doesn't depend on row order."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/bars")
    manifest(bars).write.mode("overwrite").json(f"{path}/manifest")


def manifest(bars: DataFrame) -> DataFrame:
    """Rows, first and last time, and a sum of hashes of each symbol's bars, their prices in millionths."""
    price = lambda c: F.round(F.col(c) * 1_000_000).cast("long").cast("string")
    row = F.sha2(F.concat_ws("|", F.col("time").cast("string"), *map(price, ("open", "high", "low", "close")), F.col("tick_volume").cast("string")), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("time").alias("first"), F.max("time").alias("last"), F.sum(part).cast("string").alias("digest"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The cache; raises if a symbol's bars don't match the manifest."""
    bars = spark.read.parquet(f"{path}/bars").select(*[c.split()[0] for c in BAR_SCHEMA.split(", ")])
    said = spark.read.schema("symbol string, bars long, first long, last long, digest string").json(f"{path}/manifest")
    if bad := manifest(bars).exceptAll(said).union(said.exceptAll(manifest(bars))).select("symbol").distinct().limit(5).collect():
        raise ValueError(f"bars differ from their manifest: {sorted(r[0] for r in bad)}")
    return bars


def append_log(rows: DataFrame, path: str) -> None:
    """Event rows as JSON lines, a folder for each IST day."""
    rows.withColumn("day", F.date_format(F.timestamp_seconds(F.col("ts") + 19_800), "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log; lines that aren't valid are left out."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
