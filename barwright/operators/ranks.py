"""Exact ranks within long trailing frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a sorted block.
BLOCK = 512


def _shares(v: np.ndarray, first: int, n: int) -> np.ndarray:
    """For v[first:], the share of the n values before that are less; nan: missing. Whole blocks are searched sorted, the ends of a frame are compared."""
    blocks = [np.sort(np.where(np.isnan(b), np.inf, b)) for b in (v[k : k + BLOCK] for k in range(0, len(v), BLOCK))]
    told = np.concatenate([[0], np.cumsum(~np.isnan(v))])
    out = np.full(len(v) - first, np.nan)
    at = np.arange(max(first, n), len(v))
    if not len(at):
        return out
    begin, end = -(-(at - n) // BLOCK), at // BLOCK  # whole blocks of each frame
    less = np.zeros(len(at), np.int64)
    for k, b in enumerate(blocks):
        lo, hi = np.searchsorted(end, k, side="right"), np.searchsorted(begin, k, side="right")
        if lo < hi:  # frames in order: block k is whole from where it ended until it begins to leave
            less[lo:hi] += np.searchsorted(b, v[at[lo:hi]])
    for j, i in enumerate(at.tolist()):
        a, z = int(begin[j]) * BLOCK, int(end[j]) * BLOCK
        if a >= z:
            less[j] = np.count_nonzero(v[i - n : i] < v[i])
        else:
            less[j] += np.count_nonzero(v[i - n : a] < v[i]) + np.count_nonzero(v[z:i] < v[i])
    seen = told[at] - told[at - n]
    with np.errstate(invalid="ignore", divide="ignore"):
        out[at - first] = np.where(np.isnan(v[at]) | (seen == 0), np.nan, less / seen)
    return out


def trailing_share(df: DataFrame, c: str, n: int, name: str, key: str = "symbol", rn: str = "rn") -> DataFrame:
    """df with the share of c's values in the n rows before that are strictly less than the row's; null before n rows, for a null, and where all n are null.

    A task gets a block of n rows and the n rows before it, whatever the length of the series. rn: numbers from 0.
    """
    x = df.withColumn("_block", F.explode(F.array(F.floor(F.col(rn) / n), F.floor(F.col(rn) / n) + 1)))
    # rows that only serve as the past bring nothing but their value
    own = F.col("_block") == F.floor(F.col(rn) / n)
    names = [k for k in df.columns if k not in (key, rn, c)]
    x = x.select(key, rn, c, "_block", *[F.when(own, F.col(k)).alias(k) for k in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    columns = df.columns

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rn, ignore_index=True)
        first = int((pdf[rn] < pdf["_block"].iloc[0] * n).sum())
        out = pdf.iloc[first:][columns].copy()
        out["_share"] = _shares(pdf[c].to_numpy(float), first, n)
        return out

    got = x.groupBy(key, "_block").applyInPandas(ranked, f"{schema}, _share double")
    return got.withColumn(name, F.when(~F.isnan("_share"), F.col("_share"))).drop("_share")
