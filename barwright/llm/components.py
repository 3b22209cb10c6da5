"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that isn't the least of its component; root is the least. edges: columns node, root.

    Each step sends every node's neighbours to the least one. A hub's edges are reduced by a grouped minimum with
    partial aggregation and joined back, so no task needs all of them. Each step is checkpointed.
    """
    now = edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct().checkpoint()
    state = _state(now)
    for _ in range(rounds):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select(F.col("node").alias("k"), F.least("m", "node").alias("m"))
        large = both.join(least, F.col("node") == F.col("k")).where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where("node <> root").distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("node").agg(F.min("root").alias("m")).select(F.col("node").alias("k"), "m")
        small = large.join(low, F.col("node") == F.col("k")).select(F.explode(F.array("node", "root")).alias("node"), F.col("m").alias("root"))
        now = small.where("node <> root").distinct().checkpoint()
        if (new := _state(now)) == state:
            return now
        state = new
    raise RuntimeError("components did not settle")
