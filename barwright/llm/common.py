"""Helpers that the corpus operators share: shared folder, staged tables, code shipping, even range buckets."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.shipping import ship as ship  # noqa: PLC0414  the operators import it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where spark.checkpoint.dir is unset."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: what follows doesn't compute it anew."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_order(col: Column | str) -> Column:
    """doc_id for ordering; null sorts lowest."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(-(2**63)).cast("long"))


def range_bounds(df: DataFrame, key: Column, buckets: int) -> list[int]:
    """At most buckets - 1 ascending cut points of an integer key, from a quantile sketch over all rows."""
    if buckets < 2:
        return []
    cuts = df.select(key.cast("long").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({int(c) for c in cuts})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most the key."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.size(F.filter(arr, lambda b: b <= key)).cast("int")


def sliced(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about so many bytes at most (one text at least), so that what a task makes of a slice is bounded; what Arrow holds in reserve goes back before each batch."""
    for b in batches:
        pa.default_memory_pool().release_unused()
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, min(int(np.searchsorted(ends, before + chars, side="right")), lo + rows))
            yield b.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Returns the worker's free memory to the system: workers live on between stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, hinted for broadcast where it has at most so many rows; else Spark joins it by a shuffle and splits hot keys. df is staged or checkpointed, so that counting it is cheap."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).groupBy().count().where(F.col("count") <= most).take(1)) else df


def set_apart(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with these columns under names that no operator uses, and the way back (new name to old)."""
    back = {f"passed_{k}__": c for k, c in enumerate(columns)}
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def string_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
