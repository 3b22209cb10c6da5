"""Bars: resampling, gaps, deduplication, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(ticks: DataFrame, seconds: int, offset: int = 0) -> DataFrame:
    """OHLC of ticks by buckets of that many seconds; offset shifts the buckets' border. Partial sums before the shuffle."""
    start = (F.floor((F.col("t") + offset) / seconds) * seconds - offset).cast("long")
    order = F.struct("micros", "event_id")
    return ticks.groupBy("symbol", start.alias("time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("tick_volume")
    )


def coarser(bars: DataFrame, seconds: int, offset: int = 0) -> DataFrame:
    """Bars of a longer period from bars of a shorter one."""
    start = (F.floor((F.col("time") + offset) / seconds) * seconds - offset).cast("long")
    return bars.groupBy("symbol", start.alias("start")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("tick_volume").alias("tick_volume")
    ).withColumnRenamed("start", "time")


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Where the next bar of a symbol comes later than the next period."""
    w = Window.partitionBy("symbol").orderBy("time")
    lead = F.lead("time").over(w)
    day = F.pmod(F.floor(F.col("time") / 86_400) + 3, F.lit(7))
    rows = bars.withColumn("next_time", lead).where(F.col("next_time") - F.col("time") > seconds)
    return rows.select("symbol", F.col("time").alias("after"), (F.col("next_time") - F.col("time")).alias("seconds"), (F.floor((F.col("next_time") - F.col("time")) / seconds) - 1).cast("long").alias("missing"), (day >= 4).alias("weekend"))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by that order (which should be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(left: DataFrame, right: DataFrame, values: list[str], bucket: int, left_time: str = "time", right_time: str = "time", key: str = "symbol") -> DataFrame:
    """left with the values of the last right row of its key at or before its time.

    Both sides go to buckets of time, so a long series isn't one task; what a bucket inherits is its key's last row in
    earlier buckets, found over one row a bucket.
    """
    r = right.select(F.col(key).alias("_k"), F.col(right_time).cast("long").alias("_t"), F.struct(*[F.col(v) for v in values]).alias("_v"), F.lit(0).alias("_side"))
    r = r.withColumn("_b", F.floor(F.col("_t") / bucket))
    lf = left.withColumns({"_k": F.col(key), "_t": F.col(left_time).cast("long"), "_side": F.lit(1)}).withColumn("_b", F.floor(F.col("_t") / bucket))
    last = r.groupBy("_k", "_b").agg(F.max_by("_v", "_t").alias("_last"))
    all_b = lf.select("_k", "_b").distinct().join(last, ["_k", "_b"], "full")
    w = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = all_b.withColumn("_carry", F.last("_last", ignorenulls=True).over(w)).select("_k", "_b", "_carry")
    both = lf.unionByName(r.drop("_side").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").drop("_v")
    out = found.join(carry, (found["_k"] == carry["_k"]) & (found["_b"] == carry["_b"]), "left").withColumn("_got", F.coalesce("_in", "_carry"))
    return out.select(*left.columns, *[F.col(f"_got.{v}").alias(v) for v in values])


def within(points: DataFrame, events: DataFrame, seconds: int, time: str = "time", event_time: str = "event_time") -> DataFrame:
    """points that lie within so many seconds of an event: a range semi-join as an equi-join on coarse buckets."""
    e = events.select((F.floor(F.col(event_time) / seconds)).alias("_b"), F.col(event_time).alias("_e"))
    e = e.select(F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"), "_e").distinct()
    p = points.withColumn("_b", F.floor(F.col(time) / seconds))
    return p.join(e, (p["_b"] == e["_b"]) & (F.abs(p[time] - e["_e"]) <= seconds), "left_semi").drop("_b")
