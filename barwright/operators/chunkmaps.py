"""What depends on all earlier rows of a series, in chunks: a row of maps for each chunk, chained, then each chunk walked with what comes in."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_chunk(df: DataFrame, keys: list[str], order: str, size: int, maps: Callable[[pd.DataFrame], list], map_fields: list[str], chain: Callable[[list, tuple], list], states: int, walk: Callable[[pd.DataFrame, list], pd.DataFrame], fields: str = "") -> DataFrame:
    """df's rows as walk() gives them, with further fields.

    maps: a chunk's rows to its maps (map_fields). chain: the numbers that come into a chunk (None at a series' start) and
    its maps to those that come into the next. walk: a chunk's rows and what comes in. A chunk holds ``size`` of ``order``.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    x = df.withColumn("_chunk", F.floor(F.col(order) / size))
    names, n = df.columns, len(keys)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), int(pdf["_chunk"].iloc[0]), *maps(pdf)]])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_chunk"), [None] * states, []
        for row in pdf.itertuples(index=False):
            out.append([*row[: n + 1], *state])
            state = chain(state, tuple(row[n + 1 :]))
        return pd.DataFrame(out).astype({k + n + 1: "Float64" for k in range(states)})

    rows = x.groupBy(*keys, "_chunk").applyInPandas(summary, f"{kinds}, _chunk long, " + ", ".join(map_fields))
    # one row a chunk
    carried = rows.groupBy(*keys).applyInPandas(chained, f"{kinds}, _chunk long, " + ", ".join(f"_in{k} double" for k in range(states)))
    carried = carried.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_chunk": "_c"})

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        first = [None if pd.isna(pdf[f"_in{k}"].iloc[0]) else float(pdf[f"_in{k}"].iloc[0]) for k in range(states)]
        return walk(pdf[names].copy(), first)

    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = x.join(carried, same).drop("_c", *[f"_k{i}" for i in range(n)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return met.groupBy(*keys, "_chunk").applyInPandas(again, ", ".join(filter(None, (schema, fields))))


def spaced(df: DataFrame, keys: list[str], at: str, until: str | None, gap: int, size: int = 8192) -> DataFrame:
    """Greedy choice in order of ``at``: a row stays if it comes at least gap after the last one that stayed (after its ``until``, where given).

    A chunk maps the first place that is free to the one after its last choice; choices that meet go on together, so that
    the map has few steps.
    """

    def places(pdf: pd.DataFrame) -> tuple[list, list]:
        return pdf[at].tolist(), [u + gap for u in pdf[until if until else at].tolist()]

    def maps(pdf: pd.DataFrame) -> list:
        begins, ends = places(pdf)
        after = list(ends)
        for i in range(len(begins) - 1, -1, -1):
            j = bisect_left(begins, ends[i])
            if j < len(begins):
                after[i] = after[j]
        last = [i for i in range(len(begins)) if i + 1 == len(begins) or after[i] != after[i + 1]]
        return [[float(begins[i]) for i in last], [float(after[i]) for i in last]]

    def chain(state: list, row: tuple) -> list:
        bounds, after = list(row[0]), list(row[1])
        j = 0 if state[0] is None else bisect_left(bounds, state[0])
        return [float(after[j]) if j < len(bounds) else state[0]]

    def walk(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        free, keep = state[0], np.zeros(len(pdf), bool)
        for i, (x, end) in enumerate(zip(*places(pdf), strict=True)):
            if free is None or x >= free:
                keep[i], free = True, end
        return pdf[keep]

    return by_chunk(df, keys, at, size, maps, ["_bounds array<double>", "_after array<double>"], chain, 1, walk)
