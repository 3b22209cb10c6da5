"""Moving averages that depend on all earlier rows, for series that don't fit in one task.

y is the mean of the first p values at row p, and y' = y + k (x - y) from there on. A chunk of consecutive rows maps
what comes in to A y + B, so: count and sum each chunk (small), fold each chunk on its own to A and B, chain the chunks
of a series over one row a chunk, and fold each chunk again with what comes in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.staging import staged


@dataclass(frozen=True)
class Average:
    """name: result column; value: input column; p: rows of the seed; k: weight of a new value."""

    name: str
    value: str
    p: int
    k: float


def ema(name: str, value: str, p: int) -> Average:
    return Average(name, value, p, 2.0 / (p + 1))


def wilder(name: str, value: str, p: int) -> Average:
    return Average(name, value, p, 1.0 / p)


def _fold(x: np.ndarray, before: int, total: float, y: float, a: Average) -> tuple[np.ndarray, float, float]:
    """Values of a chunk's rows, and A and B. before, total: rows before the chunk and their sum. y: what comes in."""
    out = np.full(len(x), np.nan)
    A, B, start = 1.0, y, 0
    if before < a.p:
        start = a.p - before
        if start > len(x):
            return out, 1.0, 0.0
        A, B = 0.0, (total + float(x[:start].sum())) / a.p
        out[start - 1] = B
    for i in range(start, len(x)):
        B += a.k * (x[i] - B)
        out[i] = B
    return out, A * (1 - a.k) ** (len(x) - start), B


def averages(df: DataFrame, specs: list[Average], chunk: int, key: str = "symbol", time: str = "time") -> DataFrame:
    """df with a column for each average; rows whose value is null have none. chunk: seconds of a chunk."""
    df = df.withColumn("_chunk", F.floor(F.col(time) / chunk).cast("long"))
    values = sorted({s.value for s in specs})
    sums = df.groupBy(key, "_chunk").agg(*[x for v in values for x in (F.count(v).alias(f"_n_{v}"), F.sum(v).alias(f"_s_{v}"))])
    w = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_chunk", *[F.coalesce(F.sum(f"_{x}_{v}").over(w), F.lit(0)).cast("double").alias(f"_{x}_{v}") for v in values for x in "ns"])
    rows = df.join(sums, [key, "_chunk"])
    maps = ", ".join(f"a{i} double, b{i} double" for i in range(len(specs)))
    kind = df.schema[key].dataType.simpleString()

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        out = [pdf[key].iloc[0], pdf["_chunk"].iloc[0]]
        for s in specs:
            x = pdf[s.value].dropna().to_numpy(float)
            _, a, b = _fold(x, int(pdf[f"_n_{s.value}"].iloc[0]), float(pdf[f"_s_{s.value}"].iloc[0]), 0.0, s)
            out += [a, b]
        return pd.DataFrame([out])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        rows, y = [], [0.0] * len(specs)
        for r in pdf.itertuples(index=False):
            rows.append([r[0], r[1], *y])
            y = [r[2 + 2 * i] * y[i] + r[3 + 2 * i] for i in range(len(specs))]
        return pd.DataFrame(rows)

    linear = rows.groupBy(key, "_chunk").applyInPandas(summary, f"`{key}` {kind}, _chunk long, {maps}")
    carried = linear.groupBy(key).applyInPandas(chain, f"`{key}` {kind}, _chunk long, " + ", ".join(f"_y{i} double" for i in range(len(specs))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_chunk") + ", " + ", ".join(f"`{s.name}` double" for s in specs)
    names = [f.name for f in df.schema if f.name != "_chunk"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        out = pdf[names].copy()
        for i, s in enumerate(specs):
            ok = pdf[s.value].notna().to_numpy()
            got = np.full(len(pdf), np.nan)
            got[ok], _, _ = _fold(pdf[s.value].to_numpy(float)[ok], int(pdf[f"_n_{s.value}"].iloc[0]), float(pdf[f"_s_{s.value}"].iloc[0]), float(pdf[f"_y{i}"].iloc[0]), s)
            out[s.name] = got
        return out

    folded = rows.join(carried, [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(fold, fields)
    return folded.withColumns({s.name: F.when(~F.isnan(s.name), F.col(s.name)) for s in specs})


def indicators(bars: DataFrame, chunk: int = 30 * 86_400) -> DataFrame:
    """atr14, ema20, ema50, ema200, rsi14, macd, macd_signal, macd_hist and adx14 of bars with true_range.

    Averages begin with the first row that has a value: the first true range is high less low.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    move = F.col("close") - F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    bars = bars.withColumns({
        "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))), "_tr": F.col("true_range"),
        "_plus": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)), "_minus": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
    })
    first = [wilder("atr14", "_tr", 14), ema("ema20", "close", 20), ema("ema50", "close", 50), ema("ema200", "close", 200), ema("_fast", "close", 12), ema("_slow", "close", 26)]
    first += [wilder("_up", "_gain", 14), wilder("_dn", "_loss", 14), wilder("_pdm", "_plus", 14), wilder("_mdm", "_minus", 14)]
    # each pass reads its input three times (sums, folds of chunks, folds with what comes in)
    x = averages(staged(bars, "bars"), first, chunk)
    total = F.col("_pdm") + F.col("_mdm")
    x = x.withColumns({
        "rsi14": F.when(F.col("_dn").isNull(), None).when(F.col("_dn") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_up", "_dn"))),
        "macd": F.col("_fast") - F.col("_slow"), "_dx": F.when(total > 0, 100 * F.abs(F.col("_pdm") - F.col("_mdm")) / total).otherwise(0.0),
    })
    x = averages(staged(x, "averages"), [ema("macd_signal", "macd", 9), wilder("adx14", "_dx", 14)], chunk)
    return x.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_gain", "_loss", "_tr", "_plus", "_minus", "_fast", "_slow", "_up", "_dn", "_pdm", "_mdm", "_dx")
