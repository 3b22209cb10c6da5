"""Ratchets: levels that stay until they are passed and then start anew, and the two-way states that ride on them.

A ratchet keeps its value while that lies between two bounds of the row, and takes the row's own value otherwise. All
values that leave at one row go on together, so a chunk of rows maps what comes in to itself (while it is within all bounds)
or to one of few ends: those of the rows that first pass a new highest lower bound or lowest upper bound. A chunk's map is
a row; the maps of a series are chained one row a chunk, and each chunk is walked again with what comes in. Results don't
depend on the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.blocks import beside, framed
from barwright.operators.chunkmaps import by_chunk
from barwright.operators.recurrences import averages, ema, wilder
from barwright.staging import staged


@dataclass(frozen=True)
class Ratchet:
    """name: result; value, low, high: input columns. The value before stays if low <= it <= high (inclusive), or low < it < high. The first row of a series has its own value."""

    name: str
    value: str
    low: str
    high: str
    inclusive: bool = True


def _walk(v: np.ndarray, low: np.ndarray, high: np.ndarray, inclusive: bool, y: float | None) -> np.ndarray:
    """The ratchet's values on a chunk's rows. y: what comes in, None at a series' start."""
    out = np.empty(len(v))
    for i, (x, a, b) in enumerate(zip(v.tolist(), low.tolist(), high.tolist(), strict=True)):
        if y is None or not (a <= y <= b if inclusive else a < y < b):
            y = x
        out[i] = y
    return out


def _ends(v: np.ndarray, low: np.ndarray, high: np.ndarray, inclusive: bool) -> tuple[list, list, list, list, list, list]:
    """Lowest upper bounds, the values at the chunk's end that follow from leaving there, the same for highest lower bounds, and the places of both."""
    groups: list[list] = []  # [value now, rows that lead to it]
    uppers, lowers = [], []
    top, bottom = np.inf, -np.inf
    for i, (x, a, b) in enumerate(zip(v.tolist(), low.tolist(), high.tolist(), strict=True)):
        stay = [g for g in groups if (a <= g[0] <= b if inclusive else a < g[0] < b)]
        left = [r for g in groups if not any(g is s for s in stay) for r in g[1]]
        if b < top:
            uppers.append((i, b))
            top = b
            left.append(i)
        if a > bottom:
            lowers.append((i, a))
            bottom = a
            if not left or left[-1] != i:
                left.append(i)
        if left:
            same = next((g for g in stay if g[0] == x), None)
            if same:
                same[1].extend(left)
            else:
                stay.append([x, left])
        groups = stay
    end = {r: g[0] for g in groups for r in g[1]}
    return [b for _, b in uppers], [end[i] for i, _ in uppers], [a for _, a in lowers], [end[i] for i, _ in lowers], [i for i, _ in uppers], [i for i, _ in lowers]


def _through(y: float, m: tuple, inclusive: bool) -> float:
    """What a chunk's map makes of a value: the end that belongs to the first bound that it passes, or itself."""
    uppers, upper_ends, lowers, lower_ends, upper_at, lower_at = m
    past = lambda bounds, beyond: next((k for k, b in enumerate(bounds) if beyond(b)), None)
    k = past(uppers, (lambda b: y > b) if inclusive else (lambda b: y >= b))
    j = past(lowers, (lambda a: y < a) if inclusive else (lambda a: y <= a))
    if k is None and j is None:
        return y
    if j is None or (k is not None and upper_at[k] <= lower_at[j]):
        return upper_ends[k]
    return lower_ends[j]


def ratchets(df: DataFrame, specs: list[Ratchet], key: str = "symbol", rn: str = "rn", size: int = 8192) -> DataFrame:
    """df with a column for each ratchet. Values are not null; a null low or high is no bound on that side."""

    def arrays(pdf: pd.DataFrame, s: Ratchet) -> tuple:
        return pdf[s.value].to_numpy(float), pdf[s.low].fillna(-np.inf).to_numpy(float), pdf[s.high].fillna(np.inf).to_numpy(float)

    def maps(pdf: pd.DataFrame) -> list:
        out = []
        for s in specs:
            v, low, high = arrays(pdf, s)
            out += [*map(list, _ends(v, low, high, s.inclusive)), float(_walk(v, low, high, s.inclusive, None)[-1])]
        return out

    def chain(state: list, row: tuple) -> list:
        return [float(row[7 * k + 6]) if state[k] is None else _through(state[k], row[7 * k : 7 * k + 6], s.inclusive) for k, s in enumerate(specs)]

    def walk(pdf: pd.DataFrame, first: list) -> pd.DataFrame:
        for s, y in zip(specs, first, strict=True):
            pdf[s.name] = _walk(*arrays(pdf, s), s.inclusive, y)
        return pdf

    fields = [f"_{c}{k} {t}" for k in range(len(specs)) for c, t in (("u", "array<double>"), ("ue", "array<double>"), ("l", "array<double>"), ("le", "array<double>"), ("ui", "array<long>"), ("li", "array<long>"), ("s", "double"))]
    return by_chunk(df, [key], rn, size, maps, fields, chain, len(specs), walk, ", ".join(f"`{s.name}` double" for s in specs))


def two_way(df: DataFrame, name: str, from_down: str, from_up: str, first: int, key: str = "symbol", rn: str = "rn", size: int = 8192) -> DataFrame:
    """df with a state of 1 or -1: from_down and from_up are columns with the state that follows each; the first row has first."""

    def run(pdf: pd.DataFrame, s: int) -> list[int]:
        out = []
        for a, b in zip(pdf[from_down].tolist(), pdf[from_up].tolist(), strict=True):
            s = int(b if s > 0 else a)
            out.append(s)
        return out

    def walk(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        if state[0] is None:  # the series begins here
            pdf[name] = [first, *run(pdf.iloc[1:], first)]
        else:
            pdf[name] = run(pdf, int(state[0]))
        return pdf

    def maps(pdf: pd.DataFrame) -> list:
        return [run(pdf, -1)[-1], run(pdf, 1)[-1], [first, *run(pdf.iloc[1:], first)][-1]]

    def chain(state: list, row: tuple) -> list:
        return [float(row[2] if state[0] is None else row[1] if state[0] > 0 else row[0])]

    return by_chunk(df, [key], rn, size, maps, ["_down long", "_up long", "_first long"], chain, 1, walk, f"`{name}` int")


def supertrend(bars: DataFrame, span: int, period: int = 10, multiplier: float = 3.0, size: int = 8192) -> DataFrame:
    """bars (with rn and true_range) with upper_band, lower_band, direction and supertrend.

    Bands lie at the mean of high and low, a multiple of the average range away (no range before it has ``period`` values).
    The upper band only falls until a close passes it, the lower one only rises; the line is the upper band (direction -1)
    until a close is above it, then the lower one until a close is below it. Where both bands are one, it is the upper one.
    """
    x = averages(staged(bars, "bars"), [wilder("_atr", "true_range", period)], span, time="time")
    middle, far = (F.col("high") + F.col("low")) / 2, multiplier * F.coalesce("_atr", F.lit(0.0))
    before = F.lag("close").over(beside())
    x = framed(x.withColumns({"_up": middle + far, "_low": middle - far}), {"_c1": before}, 1)
    x = ratchets(staged(x, "bands"), [Ratchet("upper_band", "_up", "_c1", "_up"), Ratchet("lower_band", "_low", "_low", "_c1")], size=size)
    up, low, w = F.col("upper_band"), F.col("lower_band"), beside()
    x = framed(staged(x, "ratchets"), {"_one": F.coalesce(F.lag("upper_band").over(w) == F.lag("lower_band").over(w), F.lit(False))}, 1)
    down_to = F.when(F.col("close") <= up, -1).otherwise(1)
    x = x.withColumns({"_down": down_to, "_rise": F.when(F.col("_one"), down_to).when(F.col("close") >= low, 1).otherwise(-1)})
    x = two_way(staged(x, "turns"), "direction", "_down", "_rise", -1, size=size)
    return x.withColumn("supertrend", F.when(F.col("direction") > 0, low).otherwise(up)).drop("_atr", "_up", "_low", "_c1", "_one", "_down", "_rise")


def qqe(bars: DataFrame, span: int, size: int = 8192) -> DataFrame:
    """bars (with rn) with rsi_ma, the bands longband and shortband, and trend (1 or -1, at first 1).

    The RSI (14, means weighted from the first bar on, which has no change) is smoothed over 5; the bands are 4.238 times its twice smoothed
    step away. The long band rises while the smoothed RSI stays above it, the short one falls while it stays below; the
    trend turns where the smoothed RSI crosses the band of the bar before.
    """
    w = beside()
    seeded = lambda a: replace(a, p=1)  # noqa: E731  the first value is the first mean
    x = framed(bars, {"_move": F.col("close") - F.lag("close").over(w)}, 1)
    x = x.withColumns({"_gain": F.coalesce(F.greatest("_move", F.lit(0.0)), F.lit(0.0)), "_loss": F.coalesce(F.greatest(-F.col("_move"), F.lit(0.0)), F.lit(0.0))})
    x = averages(staged(x, "moves"), [seeded(wilder("_up", "_gain", 14)), seeded(wilder("_dn", "_loss", 14))], span)
    rsi = F.when(F.col("_dn") > 0, 100 - 100 / (1 + F.try_divide("_up", "_dn"))).when(F.col("_up") > 0, 100.0)
    x = averages(staged(x.withColumn("_rsi", rsi), "rsi"), [seeded(ema("_ma", "_rsi", 5))], span)
    # a bar without an RSI of its own (no change yet) has none; later bars keep the mean before
    x = framed(x, {"_step": F.abs(F.lag("_ma").over(w) - F.col("_ma"))}, 1)
    x = averages(staged(x, "steps"), [seeded(ema("_s1", "_step", 27))], span)
    x = averages(staged(x, "smooth"), [seeded(ema("_s2", "_s1", 27))], span)
    x = x.withColumns({"rsi_ma": F.coalesce("_ma", F.lit(0.0)), "_far": F.coalesce("_s2", F.lit(0.0)) * 4.238})
    x = framed(x, {"_r1": F.lag("rsi_ma").over(w)}, 1)
    first = F.col("rn") == 0
    x = x.withColumns({
        "_long": F.when(first, 0.0).otherwise(F.col("rsi_ma") - F.col("_far")), "_short": F.when(first, 0.0).otherwise(F.col("rsi_ma") + F.col("_far")),
        "_least": F.least("_r1", "rsi_ma"), "_most": F.greatest("_r1", "rsi_ma"),
    })
    x = ratchets(staged(x, "bands"), [Ratchet("longband", "_long", "_long", "_least", False), Ratchet("shortband", "_short", "_most", "_short", False)], size=size)
    x = framed(staged(x, "ratchets"), {"_s": F.lag("shortband").over(w), "_l": F.lag("longband").over(w)}, 1)
    up, down = (F.col("_r1") <= F.col("_s")) & (F.col("rsi_ma") > F.col("_s")), (F.col("_r1") >= F.col("_l")) & (F.col("rsi_ma") < F.col("_l"))
    to = lambda stay: F.when(up, 1).when(down, -1).otherwise(stay)
    x = two_way(staged(x.withColumns({"_a": to(-1), "_b": to(1)}), "turns"), "trend", "_a", "_b", 1, size=size)
    return x.select(*bars.columns, "rsi_ma", "longband", "shortband", "trend")
