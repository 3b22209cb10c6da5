"""SimHash near duplicates, compared bit-sliced.

A text's shingles are its runs of three words (A-Z in lower case, split at ASCII white space), repeats included; a text
of fewer words has one of all of them. A fingerprint bit is 1 if it is set in over half the shingles' XXH64 (seed 42);
a text without words has fingerprint 0. Fingerprints link if they differ in at most ``radius`` bits.

1. Rows with one fingerprint are one node.
2. The bits are cut into ``bands`` parts. Two fingerprints within the radius agree in at least bands - radius parts, so
   that they share a bucket in one of the tables that each stand for a choice of so many parts: no link is lost.
3. A bucket of more than ``block`` nodes is dealt to blocks, and a task compares two blocks; every pair of blocks has a
   task. A task reads its nodes in order of buckets and keeps two blocks at most.
4. Within a task 64 nodes are one word of each of 64 vertical bit planes. A query's bit flips its plane, carry-save
   adders feed the planes three at a time to counters of ceil(log2(radius + 1)) bits, whose overflow marks the nodes
   beyond the radius; a word of 64 nodes is abandoned once all are. Links leave a task as a spanning forest.
5. Components of the forests, and the least id of each.

Nulls: a null text is empty; a null id is allowed and never a component's id if the component has another. Repeated rows
share a node. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, shuffle_partitions, sliced, small, staged, string_list
from barwright.llm.components import components

SEED, WORDS, RADIUS, BANDS = 42, 3, 2, 4
_ALL = np.uint64(2**64 - 1)


def fingerprint(text: str, words: int = WORDS, part: int = 200_000) -> int:
    """The 64 majority bits of the shingles' hashes; so many shingles are held at a time."""
    tokens = text.encode().lower().split()  # both know ASCII alone
    if not tokens:
        return 0
    digest, k = xxhash.xxh64_intdigest, min(words, len(tokens))
    n, ones = len(tokens) - k + 1, np.zeros(64, np.int64)
    for lo in range(0, n, part):
        own = tokens[lo : lo + part + k - 1]
        runs = zip(*(own[i:] for i in range(k)), strict=False)
        h = np.fromiter((digest(b" ".join(r), SEED) for r in runs), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "text"):
        got = np.array([fingerprint(t) for t in string_list(b.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane j is bit j of fingerprint 64 w + i."""
    padded = np.zeros(-(-len(prints) // 64) * 64, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(vertical: np.ndarray, queries: np.ndarray, words: np.ndarray, near: np.ndarray, radius: int, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, word of the planes) and masks of the nodes asked for: the pairs' places and masks of the nodes within the radius.

    Counters start at 2^size - 1 - radius, so that a carry out of the highest says that the radius is passed.
    """
    size = max(radius.bit_length(), 1)
    start = 2**size - 1 - radius
    at, q, w = np.arange(len(queries)), queries, words
    count = [np.full(len(q), _ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
    dead = ~near

    def add(bit: np.ndarray, level: int) -> None:
        nonlocal dead
        for k in range(level, size):
            count[k], bit = count[k] ^ bit, count[k] & bit
        dead = dead | bit

    def differ(j: int) -> np.ndarray:
        return vertical[j][w] ^ (np.uint64(0) - (q >> np.uint64(j) & np.uint64(1)))

    for lo in range(0, 64, step):
        for j in range(lo, min(lo + step, 64), 3):
            if j + 2 < 64:
                a, b, c = differ(j), differ(j + 1), differ(j + 2)
                x = a ^ b
                add(x ^ c, 0)
                carry = (a & b) | (x & c)
                if size > 1:
                    add(carry, 1)
                else:  # two more than a counter of one bit holds
                    dead = dead | carry
            else:
                for i in range(j, 64):
                    add(differ(i), 0)
        live = dead != _ALL
        if not live.all():  # words whose nodes are all beyond the radius are abandoned
            at, q, w, dead = at[live], q[live], w[live], dead[live]
            count = [x[live] for x in count]
            if not len(at):
                break
    return at, ~dead


def _mask(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words whose bits lo to hi - 1 are set (0 <= lo, hi <= 64)."""
    below = lambda k: np.where(k >= 64, _ALL, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    return below(hi) & ~below(lo)


def linked(prints: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int = RADIUS, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints within the radius, j from start[i] to stop[i] - 1, a bounded part of the questions at a time."""
    vertical = planes(prints)
    asks = np.flatnonzero(stop > start)
    first, last = start[asks] // 64, (stop[asks] - 1) // 64
    ends = np.cumsum(last - first + 1)
    lo = 0
    while lo < len(asks):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        own, n = asks[lo:hi], (last - first + 1)[lo:hi]
        i = np.repeat(own, n)
        w = np.repeat(first[lo:hi], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = _mask(np.clip(start[i] - 64 * w, 0, 64), np.clip(stop[i] - 64 * w, 0, 64))
        at, found = within(vertical, prints[i], w, near, radius)
        if len(at):
            bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x, y = np.nonzero(bits)
            yield i[at[x]], w[at[x]] * 64 + y
        lo = hi


def forest(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place of each place's component."""
    root = np.arange(n)
    for i, j in parts:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows that come in order of table, bucket, lo, hi, side: the nodes of a task follow one another, those of block hi last."""

    def edges(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        ends = np.append(new[1:], len(fp))
        of = np.repeat(np.arange(len(new)), ends - new)
        crosses = key[new, 2] != key[new, 3]  # tasks of two blocks compare across alone
        second = new + np.add.reduceat((side == 0).astype(np.int64), new)
        place = np.arange(len(fp))
        start = np.where(crosses[of], second[of], place + 1)
        stop = np.where(crosses[of] & (side == 1), 0, ends[of])
        root = forest(len(fp), linked(fp, start, stop, radius))
        out = np.flatnonzero(root != place)
        return pa.RecordBatch.from_arrays([pa.array(fp[out].view(np.int64)), pa.array(fp[root[out]].view(np.int64))], names=["node", "root"])

    kept: list[np.ndarray] = []
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "bucket", "lo", "hi", "side", "fp")]
        rows = np.stack(cols, axis=1)
        rows = np.concatenate([*kept, rows])
        cut = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        done = int(cut[-1]) + 1 if len(cut) else 0
        if done:
            yield edges(rows[:done, :4], rows[:done, 4], rows[:done, 5].copy().view(np.uint64))
        kept = [rows[done:]]
    if kept and len(kept[0]):
        rows = kept[0]
        yield edges(rows[:, :4], rows[:, 4], rows[:, 5].copy().view(np.uint64))


def tables(bands: int, radius: int) -> list[int]:
    """Masks of the bits that each table's buckets are made of."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(bands)]
    return [sum(c) for c in combinations(parts, bands - radius)]


def links(nodes: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = 4096) -> DataFrame:
    """node, root: a spanning forest of each task over nodes (distinct fingerprints in column fp)."""
    masks = F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in tables(bands, radius)])
    dealt = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("table", "bucket"))
    sizes = dealt.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = staged(sizes.where(F.col("size") > block).select(F.col("table").alias("t"), F.col("bucket").alias("b"), F.ceil(F.col("size") / block).cast("int").alias("blocks")), "buckets")
    placed = dealt.join(small(large), (F.col("table") == F.col("t")) & (F.col("bucket") == F.col("b")), "left").drop("t", "b")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi"), (o < F.col("own")).cast("int").alias("side")))
    tasks = placed.select("table", "bucket", F.explode(others).alias("p"), "fp").select("table", "bucket", "p.lo", "p.hi", "p.side", "fp")
    n = shuffle_partitions(nodes.sparkSession)
    ordered = tasks.repartition(n, "table", "bucket", "lo", "hi").sortWithinPartitions("table", "bucket", "lo", "hi", "side", "fp")
    return ordered.mapInArrow(lambda it: _compared(it, radius), "node long, root long")


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(_signed, "doc_id long, fp long")


def grouped(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the component): one row for each of docs."""
    if not 0 <= radius < bands <= 64:
        raise ValueError("bands must be more than the radius, and at most 64")
    rows = staged(signed(docs), "simhash")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(nodes, radius, bands, block)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = staged(placed, "components")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
