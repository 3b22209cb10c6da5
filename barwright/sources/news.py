"""News calendars: nested JSON maps of days, merged by key, and the events near or after a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = "map<string,array<struct<name:string,utc_time:string>>>"


def write_calendar(events: DataFrame, path: str) -> None:
    """events (date, name, utc_time) as JSON texts, a map of one day a line."""
    day = events.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("name", "utc_time"))).alias("events"))
    day.select(F.to_json(F.map_from_arrays(F.array("date"), F.array("events"))).alias("value")).write.mode("overwrite").text(path)


def read_calendar(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """date, name, utc_time, place (in its day) of JSON texts that map dates to lists of events; whole: a file is one text. Texts that aren't such maps have none."""
    texts = spark.read.text(path, wholetext=whole)
    days = texts.select(F.explode(F.from_json("value", DAY)).alias("date", "events"))
    return days.select("date", F.posexplode("events").alias("place", "e")).select("date", "e.name", "e.utc_time", "place")


def merged(base: DataFrame, override: DataFrame) -> DataFrame:
    """All of base, and what override has at times of a day that base doesn't; base's events of a day come first."""
    known = base.select(F.col("date").alias("_d"), F.col("utc_time").alias("_t")).distinct()
    more = override.join(known, F.col("date").eqNullSafe(F.col("_d")) & F.col("utc_time").eqNullSafe(F.col("_t")), "left_anti")
    return base.withColumn("later", F.lit(0)).unionByName(more.withColumn("later", F.lit(1)))


def event_time(date: Column, utc_time: Column) -> Column:
    """Epoch seconds of a date and H:MM; null where either isn't one."""
    hour, minute = F.regexp_extract(utc_time, "^([0-9]{1,2}):([0-9]{1,2})$", 1).try_cast("int"), F.regexp_extract(utc_time, "^([0-9]{1,2}):([0-9]{1,2})$", 2).try_cast("int")
    day = F.unix_date(F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date).try_cast("date"))
    return F.when((hour < 24) & (minute < 60), day.cast("long") * 86_400 + hour * 3600 + minute * 60)


def scheduled(calendar: DataFrame) -> DataFrame:
    """Events whose name, date and time are well formed, with due (epoch seconds)."""
    return calendar.withColumn("due", event_time(F.col("date"), F.col("utc_time"))).where("due IS NOT NULL AND name IS NOT NULL")


def blackout(points: DataFrame, events: DataFrame, time: str, minutes: int = 15) -> DataFrame:
    """points with name, minutes_off and direction (before or after) of the first event by day and place that is at most so many minutes away, else null."""
    span = max(minutes * 60, 60)
    # a point meets the events of its bucket and the two beside
    e = events.select(F.explode(F.array(*[F.floor(F.col("due") / span) + k for k in (-1, 0, 1)])).alias("_b"), F.col("due").alias("_at"), F.struct("date", "later", "place", "name").alias("_e"))
    times = points.select(F.col(time).alias("_t")).distinct().withColumn("_p", F.floor(F.col("_t") / span))
    near = times.join(e, F.col("_p") == F.col("_b")).where(F.abs(F.col("_t") - F.col("_at")) <= minutes * 60)
    first = near.groupBy("_t").agg(F.min_by(F.struct("_e", "_at"), F.struct("_e", "_at")).alias("_f"))
    out = points.join(first, F.col(time) == F.col("_t"), "left")
    at = F.col("_f._at")
    return out.withColumns({"name": F.col("_f._e.name"), "minutes_off": F.round(F.abs(F.col(time) - at) / 60).cast("long"), "direction": F.when(F.col(time) < at, "before").when(at.isNotNull(), "after")}).drop("_t", "_f")


def upcoming(points: DataFrame, events: DataFrame, time: str, hours: float = 4.0) -> DataFrame:
    """The events of the next hours from each point: time, name, date, utc_time, minutes_away, nth (by time, day and place)."""
    span = int(hours * 3600)
    e = events.select(F.explode(F.array(F.floor(F.col("due") / span), F.floor(F.col("due") / span) - 1)).alias("_b"), "due", "name", "date", "utc_time", "later", "place")
    times = points.select(F.col(time).alias(time)).distinct().withColumn("_p", F.floor(F.col(time) / span))
    near = times.join(e, F.col("_p") == F.col("_b")).where((F.col("due") >= F.col(time)) & (F.col("due") <= F.col(time) + span))
    w = Window.partitionBy(time).orderBy("due", "date", "later", "place", "name")
    return near.select(time, "name", "date", "utc_time", F.floor((F.col("due") - F.col(time)) / 60).alias("minutes_away"), F.row_number().over(w).alias("nth"))
