"""Event-driven forms: closed bars with a watermark, duplicate suppression, and per-strategy state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def closed_bars(ticks: DataFrame, period: str = "1 hour", late: str = "10 minutes", offset: str = "0 seconds") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, event_id, price), each emitted once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    w = F.window("ts", period, period, offset)
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", w.alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("tick_volume"))
        .select("symbol", F.unix_seconds(F.col("w.start")).alias("time"), "open", "high", "low", "close", "tick_volume")
    )


def deduplicated(signals: DataFrame, keys: list[str], ttl: str = "2 hours") -> DataFrame:
    """The first signal of each key within the time to live."""
    return signals.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


class Cooldown(StatefulProcessor):
    """Passes a strategy's signal unless one passed within ``seconds`` before it; the state is one number a strategy."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        df = pd.concat(list(rows)).sort_values(["t", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t, e in zip(df["t"], df["event_id"], strict=True):
            if last is None or t - last >= self.seconds:
                kept.append((key[0], int(t), int(e)))
                last = int(t)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(kept, columns=["strategy", "t", "event_id"])

    def close(self) -> None:
        pass


def cooled(signals: DataFrame, seconds: int = 2700) -> DataFrame:
    """Signals (strategy, t, event_id) with a pause after each one that passes."""
    return signals.groupBy("strategy").transformWithStateInPandas(Cooldown(seconds), "strategy string, t long, event_id long", "Append", "None")
