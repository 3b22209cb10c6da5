"""Long series in blocks: numbering, frames and running sums by chunk, and trees of blocks for first passages, extremes and open intervals.

No step needs a whole series in one task: rows are dealt by (key, chunk of row numbers), frames get the rows that they need
of the chunks beside, and what lies further away is met through a tree whose nodes hold the extremes of ``FAN`` children.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.staging import staged

#: Children of a node; rows of a chunk.
FAN, CHUNK = 64, 8192


def numbered(df: DataFrame, key: str = "symbol", time: str = "time", span: int = 30 * 86_400) -> DataFrame:
    """df with rn, the row's number in its series from 0. span: seconds of time of a task. Times of a series are distinct."""
    x = df.withColumn("_span", F.floor(F.col(time) / span))
    sizes = x.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_k", "_s", before.alias("_before"))  # a row for each span
    own = F.row_number().over(Window.partitionBy(key, "_span").orderBy(time)) - 1
    return x.withColumn("_own", own).join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s"))).withColumn("rn", F.col("_before") + F.col("_own")).drop("_span", "_k", "_s", "_own", "_before")


def framed(df: DataFrame, columns: dict[str, Column] | list[dict[str, Column]], before: int, after: int = 0, key: str = "symbol", rn: str = "rn", size: int = CHUNK) -> DataFrame:
    """df with columns over beside(), one step after another: each chunk of rows also gets the rows just before and after it. size is raised where the frames are longer."""
    size = max(size, before + after)
    at = F.col(rn)
    chunks = F.array_distinct(F.array(F.floor(at / size), F.floor((at + before) / size), F.floor((at - after) / size)))
    dealt = df.withColumn("_chunk", F.explode(chunks))
    out = dealt
    for step in columns if isinstance(columns, list) else [columns]:
        out = out.withColumns(step)
    return out.where(F.col("_chunk") == F.floor(at / size)).drop("_chunk")


def beside(key: str = "symbol", rn: str = "rn"):
    """The window that framed() gives its columns."""
    return Window.partitionBy(key, "_chunk").orderBy(rn)


def cumulated(df: DataFrame, values: dict[str, Column], key: str = "symbol", rn: str = "rn", size: int = CHUNK) -> DataFrame:
    """df with running sums up to each row."""
    x = df.withColumns({"_chunk": F.floor(F.col(rn) / size), **{f"_v{k}": v for k, v in enumerate(values.values())}})
    sums = x.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(values))])
    w = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_c", *[F.coalesce(F.sum(f"_t{k}").over(w), F.lit(0)).alias(f"_b{k}") for k in range(len(values))])
    own = beside(key, rn).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_o{k}": F.sum(f"_v{k}").over(own) for k in range(len(values))})
    x = x.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    made = [(F.col(f"_b{k}") + F.coalesce(f"_o{k}", F.lit(0))).alias(n) for k, n in enumerate(values)]
    return x.select(*[c for c in df.columns if c not in values], *made)


@dataclass(frozen=True)
class Tree:
    """levels[0] has nodes of rows, levels[k] of nodes of levels[k - 1]: _k (key), _node, _c: array of (v, p) by child, p the negative number of the first row with the greatest v."""

    levels: list[DataFrame]
    fan: int
    key: str


def height(df: DataFrame, rn: str = "rn", fan: int = FAN) -> int:
    """Levels of a tree over rows up to the greatest number."""
    n, h = int(df.agg(F.coalesce(F.max(rn), F.lit(0)).alias("n")).first()["n"]) + 1, 1
    while fan**h < n:
        h += 1
    return h


def tree(df: DataFrame, value: Column, key: str = "symbol", rn: str = "rn", fan: int = FAN) -> Tree:
    """The tree of greatest values; of the least ones where value is negated. df has all row numbers from 0; nulls count as least."""
    rows = df.select(F.col(key).alias("_k"), F.col(rn).cast("long").alias("_at"), F.struct(F.coalesce(value.cast("double"), F.lit(float("-inf"))).alias("v"), (-F.col(rn)).cast("long").alias("p")).alias("_e"))
    levels = []
    for _ in range(height(df, rn, fan)):
        node = rows.groupBy("_k", F.floor(F.col("_at") / fan).alias("_node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias("_c"))
        levels.append(staged(node, "tree"))
        rows = levels[-1].select("_k", F.col("_node").alias("_at"), F.array_max("_c").alias("_e"))
    return Tree(levels, fan, key)


def _node(df: DataFrame, level: DataFrame, key: str, node: Column, name: str) -> DataFrame:
    """df with the children of the node of its key, null where there is none."""
    own = level.select(F.col("_k").alias("_k2"), F.col("_node").alias("_n2"), F.col("_c").alias(name))
    return df.withColumn("_ask", node).join(own, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("_ask") == F.col("_n2")), "left").drop("_ask", "_k2", "_n2")


def first_passage(asks: DataFrame, t: Tree, start: str, above: Column, name: str = "passed") -> DataFrame:
    """asks with the first row number from start on whose value exceeds above, or null.

    Up the tree, level by level, until a later sibling's extreme passes, then down to the row: one equi-join a level.
    """
    x = asks.withColumns({"_above": above, "_level": F.lit(None).cast("int"), "_to": F.lit(None).cast("long")})
    fan = t.fan
    later = lambda first: F.expr(f"nullif(array_position(transform(_c, (e, i) -> e.v > _above and i >= {first}), true), 0) - 1")
    for k, level in enumerate(t.levels):
        at = F.floor(F.col(start) / fan**k)
        x = _node(x.withColumns({"_at": at, "_first": F.pmod(at, F.lit(fan)) + (1 if k else 0)}), level, t.key, F.when(F.col("_level").isNull(), F.floor(F.col("_at") / fan)), "_c")
        hit = later("_first")
        x = x.withColumns({"_to": F.coalesce("_to", F.floor(F.col("_at") / fan) * fan + hit), "_level": F.coalesce("_level", F.when(hit.isNotNull(), k))}).drop("_c", "_at", "_first")
    for k in range(len(t.levels) - 1, 0, -1):
        x = _node(x, t.levels[k - 1], t.key, F.when(F.col("_level") >= k, F.col("_to")), "_c")
        x = x.withColumn("_to", F.when(F.col("_level") >= k, F.col("_to") * fan + later("0")).otherwise(F.col("_to"))).drop("_c")
    return x.withColumnRenamed("_to", name).drop("_above", "_level")


def extremes(asks: DataFrame, t: Tree, first: str, last: str, name: str) -> DataFrame:
    """asks with the greatest value of rows first to last in name, and the first row that has it in name_rn; null for an empty range."""
    x = asks.withColumns({"_l": F.col(first).cast("long"), "_r": F.col(last).cast("long"), "_best": F.lit(None).cast("struct<v:double,p:long>")})
    fan = t.fan
    for level in t.levels:
        one = F.floor(F.col("_l") / fan) == F.floor(F.col("_r") / fan)
        open_ = F.col("_l") <= F.col("_r")
        x = x.withColumns({"_one": one, "_open": open_})
        x = _node(x, level, t.key, F.when(F.col("_open"), F.floor(F.col("_l") / fan)), "_a")
        x = _node(x, level, t.key, F.when(F.col("_open") & ~F.col("_one"), F.floor(F.col("_r") / fan)), "_b")
        left = F.expr(f"array_max(slice(_a, cast(pmod(_l, {fan}) + 1 as int), cast(if(_one, _r - _l + 1, {fan}) as int)))")
        right = F.expr(f"array_max(slice(_b, 1, cast(pmod(_r, {fan}) + 1 as int)))")
        x = x.withColumn("_best", F.array_max(F.array_compact(F.array("_best", left, right))))
        up = F.col("_open") & ~F.col("_one")
        x = x.withColumns({"_l": F.when(up, F.floor(F.col("_l") / fan) + 1).otherwise(F.lit(1)), "_r": F.when(up, F.floor(F.col("_r") / fan) - 1).otherwise(F.lit(0))}).drop("_a", "_b", "_one", "_open")
    return x.withColumns({name: F.col("_best.v"), f"{name}_rn": -F.col("_best.p")}).drop("_l", "_r", "_best")


def _at_level(k: int) -> Callable[[Column], Column]:
    return lambda n: F.struct(F.lit(k).alias("level"), n.alias("node"))


def open_extremes(df: DataFrame, intervals: DataFrame, value: Column, first: str, last: str, name: str, key: str = "symbol", rn: str = "rn", fan: int = 16) -> DataFrame:
    """df with the greatest value of the intervals that are open at each row (first to last, both within), or null.

    An interval is cut into at most 2 * fan nodes a level; a row lies in one node a level. Neither side meets the other row by row.
    """
    h, parts = height(df, rn, fan), []
    for k in range(h + 1):
        # pointers at level k when those below have moved past their parents' ends
        more = sum(fan**j for j in range(1, k))
        left = F.floor((F.col("_l") + more) / fan**k) + (1 if k else 0)
        right = F.floor((F.col("_r") - more - (fan**k if k else 0)) / fan**k)
        one = F.floor(left / fan) == F.floor(right / fan)
        ends = F.when(one, F.sequence(left, F.greatest(left, right))).otherwise(F.concat(F.sequence(left, (F.floor(left / fan) + 1) * fan - 1), F.sequence(F.floor(right / fan) * fan, right)))
        parts.append(F.when(left <= right, F.transform(ends, _at_level(k))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>")))
    covered = intervals.withColumns({"_l": F.col(first).cast("long"), "_r": F.col(last).cast("long")}).select(F.col(key).alias("_k"), value.alias("_v"), F.explode(F.flatten(F.array(*parts))).alias("_p"))
    nodes = staged(covered.groupBy("_k", F.col("_p.level").alias("_level"), F.col("_p.node").alias("_node")).agg(F.max("_v").alias("_v")), "open")
    x = df
    for k in range(h + 1):
        own = nodes.where(F.col("_level") == k).select(F.col("_k").alias(f"_k{k}"), F.col("_node").alias(f"_n{k}"), F.col("_v").alias(f"_v{k}"))
        x = x.join(own, F.col(key).eqNullSafe(F.col(f"_k{k}")) & (F.floor(F.col(rn) / fan**k) == F.col(f"_n{k}")), "left").drop(f"_k{k}", f"_n{k}")
    return x.withColumn(name, F.array_max(F.array(*[F.col(f"_v{k}") for k in range(h + 1)]))).drop(*[f"_v{k}" for k in range(h + 1)])


def placed(asks: DataFrame, rows: DataFrame, at: str, name: str, time: str = "time", key: str = "symbol", span: int = 30 * 86_400) -> DataFrame:
    """asks with the number of rows of their key whose time is before at: the row number (from 0) of the first one not before it."""
    cols = [F.col(c) for c in asks.columns]
    a = asks.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_t"), F.struct(*cols).alias("_a"), F.lit(0).alias("_is"))
    r = rows.select(F.col(key).alias("_k"), F.col(time).cast("long").alias("_t"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), F.lit(1).alias("_is"))
    both = a.unionByName(r).withColumn("_s", F.floor(F.col("_t") / span))
    sums = both.groupBy(F.col("_k").alias("_k2"), F.col("_s").alias("_s2")).agg(F.sum("_is").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_k2").orderBy("_s2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # at one time asks come before rows
    inside = F.sum("_is").over(Window.partitionBy("_k", "_s").orderBy("_t", "_is").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("_in", inside).where("_is = 0").join(sums, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_s").eqNullSafe(F.col("_s2")))
    return own.select("_a.*", F.when(F.col("_t").isNotNull(), F.col("_before") + F.col("_in")).alias(name))
