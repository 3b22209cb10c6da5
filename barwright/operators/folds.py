"""State machines over ordered rows: each key's rows go through a fold batch by batch, so that no task holds a series.

Rows are dealt by key and sorted within partitions (a sort that spills); the state of the key at hand is carried from one
batch to the next. For what depends on all earlier rows of a series and has no form as a frame or a chain of linear maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes a key's next rows, in order, and gives them (or some of them) with new columns.
Fold = Callable[[pd.DataFrame], pd.DataFrame]


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Fold], fields: str) -> DataFrame:
    """start() gives a fold for a new key. fields: schema of the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            new[0] = True
            for k in keys:
                x = pdf[k].astype(object).where(pdf[k].notna(), None).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            edges = [*np.flatnonzero(new).tolist(), len(pdf)]
            out = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = pdf.iloc[lo:hi]
                own = tuple(None if pd.isna(v) else v for v in part[keys].iloc[0])
                if fold is None or own != key:
                    key, fold = own, start()
                out.append(fold(part))
            yield pd.concat(out, ignore_index=True)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, fields)


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


class StopAndReverse:
    """Wilder's parabolic level: it nears the trend's extreme by a rate that grows with each new extreme, and turns where price passes it.

    A bar's level comes from the bar before and never lies beyond the extremes of the last two bars. Only then is the bar
    held against it: a bar that passes it turns the trend, and the level becomes the extreme of the trend that ended (or of
    the bar, if that is further away).
    """

    def __init__(self, step: float, more: float, most: float):
        self.step, self.more, self.most = step, more, most
        self.side = 0  # 1: rising, -1: falling, 0: no bar yet

    def next(self, high: float, low: float) -> float | None:
        if not self.side:
            self.side, self.rate, self.level, self.extreme, self.recent = 1, self.step, low, high, [(high, low)]
            return None
        beyond = min if self.side > 0 else max
        ahead, behind = (high, low) if self.side > 0 else (low, high)
        level = beyond(self.level + self.rate * (self.extreme - self.level), *(bar[self.side > 0] for bar in self.recent))
        if self.side * (behind - level) < 0:
            level = (max if self.side > 0 else min)(self.extreme, ahead)
            self.side, self.extreme, self.rate = -self.side, behind, self.step
        elif self.side * (ahead - self.extreme) > 0:
            self.extreme, self.rate = ahead, min(self.rate + self.more, self.most)
        self.level, self.recent = level, [*self.recent[-1:], (high, low)]
        return level


def parabolic_sar(bars: DataFrame, step: float = 0.02, more: float = 0.02, most: float = 0.2) -> DataFrame:
    """bars with sar: null on a series' first bar, from whose low it begins to rise."""

    def start() -> Fold:
        level = StopAndReverse(step, more, most)

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(sar=[np.nan if x is None else x for x in map(level.next, pdf["high"].tolist(), pdf["low"].tolist())])

        return fold

    x = folded(bars, ["symbol"], ["time"], start, schema_of(bars, "sar double"))
    return x.withColumn("sar", F.when(~F.isnan("sar"), F.col("sar")))
