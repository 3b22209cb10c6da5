"""Reports of runs: derived columns of trades, and sinks and sources for trades, series of tuples, summaries and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADES = "trade_id long, entry_time long, entry_datetime string, exit_time long, exit_datetime string, direction string, entry_price double, exit_price double, net_pl double, pips double, strategy string, exit_reason string, duration_minutes double, trade_result string, return_r double"


def derived(trades: DataFrame, pip: float = 0.01) -> DataFrame:
    """The columns of a trades report. Pips have the sign of the result (a scratch of a buy counts as a loss, of a sell as a gain); return_r is the result's sign."""
    moved = F.abs(F.col("exit_price") - F.col("entry_price")) / pip
    gained = F.when(F.col("is_buy"), F.col("net_pl") > 0).otherwise(F.col("net_pl") >= 0)
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    return trades.select(
        "trade_id", "entry_time", stamp("entry_time").alias("entry_datetime"), "exit_time", stamp("exit_time").alias("exit_datetime"), F.when(F.col("is_buy"), "BUY").otherwise("SELL").alias("direction"),
        F.round("entry_price", 2).alias("entry_price"), F.round("exit_price", 2).alias("exit_price"), (F.round("net_pl", 2) + 0.0).alias("net_pl"), (F.round(F.when(gained, moved).otherwise(-moved), 1) + 0.0).alias("pips"), "strategy", "exit_reason",
        F.round((F.col("exit_time") - F.col("entry_time")) / 60.0, 1).alias("duration_minutes"), F.when(F.col("net_pl") > 0, "WIN").when(F.col("net_pl") < 0, "LOSS").otherwise("SCRATCH").alias("trade_result"), (F.signum("net_pl") + 0.0).alias("return_r"),
    )


def write_trades(trades: DataFrame, path: str, run: str) -> None:
    """derived() rows as CSV in the run's partition; a run that is written again replaces its partition alone, other runs stay."""
    out = trades.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run")
    out.option("partitionOverwriteMode", "dynamic").option("header", True).csv(path)


def read_trades(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Trades of one run or all, with run; lines that don't fit the columns are left out."""
    rows = spark.read.schema(f"{TRADES}, run string").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return rows if run is None else rows.where(F.col("run") == run)


def write_series(trades: DataFrame, path: str) -> None:
    """A line [entry_time, exit_time, net_pl, risk] for each trade."""
    numbers = F.array(*[F.col(c).cast("double") for c in ("entry_time", "exit_time", "net_pl", "risk")])
    trades.where("exit_time IS NOT NULL").select(F.to_json(numbers).alias("value")).write.mode("overwrite").text(path)


def read_series(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """entry_time, exit_time, net_pl, risk, r of tuples of four numbers, or of three (the exit is the entry); without those whose risk isn't positive.

    A line holds a tuple or a list of tuples; whole: a file is one list, over several lines.
    """
    text = F.trim("value")
    one = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    many = F.from_json(text, "array<array<double>>")
    rows = spark.read.text(path, wholetext=whole).select(F.explode(F.when(text.rlike(r"^\[\s*\["), many).otherwise(F.array(one))).alias("x"))
    rows = rows.where(F.size("x").isin(3, 4)).select(F.when(F.size("x") == 3, F.array(F.col("x")[0], F.col("x")[0], F.col("x")[1], F.col("x")[2])).otherwise(F.col("x")).alias("x"))
    out = rows.select(F.col("x")[0].cast("long").alias("entry_time"), F.col("x")[1].cast("long").alias("exit_time"), F.col("x")[2].alias("net_pl"), F.col("x")[3].alias("risk"))
    return out.where("risk > 0").withColumn("r", F.col("net_pl") / F.col("risk"))


def write_manifest(trades: DataFrame, path: str, run: str, settings: dict[str, str]) -> None:
    """One JSON line for a run: its settings, counts and span."""
    row = trades.agg(F.count(F.lit(1)).alias("trades"), F.min("entry_time").alias("first"), F.max("exit_time").alias("last"), F.sum("net_pl").alias("net_pl"))
    named = F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv]) if settings else F.create_map().cast("map<string,string>")
    row.select(F.lit(run).alias("run"), named.alias("settings"), "*").write.mode("overwrite").json(f"{path}/run={run}")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, settings map<string,string>, trades long, first long, last long, net_pl double").json(f"{path}/*")


def latest(manifests: DataFrame) -> DataFrame:
    """The run that ends last, of equal ones the greatest name."""
    return manifests.orderBy(F.desc("last"), F.desc("run")).limit(1)
