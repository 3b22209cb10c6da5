"""N-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of five words (lower case, split at white space); a text of fewer words has one n-gram of
all of them, and a text without words none. Two documents are linked if the Jaccard similarity of their n-gram sets is
at least the threshold; sets without n-grams are alike to each other only.

1. Each row gets a 128-bit key of its n-gram set and MinHash bands; rows with one key are one node with a weight.
2. Nodes that share a band hash are candidates: a shuffle on band hashes sends every node to the least of its bucket,
   and the components of these stars are groups outside of which no candidate pair exists.
3. Each group with two nodes or more gets its texts, one a node, in blocks of about ``block`` nodes and ``block_grams``
   n-grams. A task holds two blocks at most; it verifies each pair that shares a band on full n-gram sets, by merging two
   sets or, where a tile holds many such pairs, by products of 0-1 matrices in slices of columns, and returns each node's
   links and a spanning forest, never the pairs. A larger group is covered by all its pairs of blocks: no link is lost.
4. Components of the forests are the classes.

Nulls: a null text is empty; a null id is allowed and never a class's id if the class has another. Repeated rows are
rows of one node; of rows that are equal in id, text, lang and source, one stands for all (``one_of_each`` keeps one of them). Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import give_back, ship, sliced, small, staged, string_list
from barwright.llm.components import components

WORDS, THRESHOLD = 5, 0.8
_SPACE = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def banding(threshold: float = THRESHOLD, recall: float = 0.9995, most: int = 128) -> tuple[int, int]:
    """Bands and rows a band: the most rows for which a pair at the threshold is found with the target recall."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches the recall")


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The set of n-gram hashes (sorted uint64) of each text."""
    arr = pc.utf8_trim(pc.utf8_lower(pa.array(texts, pa.large_string())), _TRIM)
    split = pc.split_pattern_regex(arr, _SPACE)
    offsets = split.offsets.to_numpy()
    coded = pc.dictionary_encode(split.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))[coded.indices.to_numpy()]
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
    mult = np.resize(mult, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
    grams = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        grams = (grams ^ (grams >> np.uint64(31))) * mult[k] + hashes[k : k + len(grams)]
    out = []
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b - a > 1 or (b - a == 1 and arr[t].as_py() != ""):
            out.append(np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(1, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band; the band's number is part of it."""
        low = np.full(len(self.a), np.uint64(2**64 - 1))
        for k in range(0, len(grams), 4096):
            part = grams[k : k + 4096]
            low = np.minimum(low, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1))
        key = np.arange(self.bands, dtype=np.uint64)
        for r in low.reshape(self.bands, self.rows).T:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + r
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    mh = MinHash(bands, rows)
    for b in sliced(batches, "text"):
        sets = shingles(string_list(b.column("text")))
        sig = [mh.signature(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("row_key"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())],
            names=["doc_id", "row_key", "node", "bands", "grams"],
        )
    give_back()


def _verify(texts: list[str], keys: list[bytes], weights: list[int], blocks: list[int], pair: tuple[int, int], mh: MinHash, threshold: float) -> tuple[np.ndarray, list[int]]:
    """Weights of linked nodes and a spanning forest (each node's root) over the pairs that (block, block) stands for."""
    n = len(texts)
    sets = shingles(texts)
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.stack([mh.signature(s) for s in sets])
    links, parent = np.zeros(n, np.int64), list(range(n))
    w, blk = np.array(weights, np.int64), np.array(blocks)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = 256
    for i in range(0, n, step):
        hi = min(i + step, n)
        for j in range(i, n, step):
            hj = min(j + step, n)
            band = np.zeros((hi - i, hj - j), bool)
            for k in range(sig.shape[1]):
                band |= sig[i:hi, k, None] == sig[None, j:hj, k]
            small, large = np.minimum(sizes[i:hi, None], sizes[None, j:hj]), np.maximum(sizes[i:hi, None], sizes[None, j:hj])
            band &= (small > 0) & (small >= threshold * large - 1e-9)
            # of two blocks, only pairs across; of one, each pair once
            band &= np.arange(i, hi)[:, None] < np.arange(j, hj)[None, :]
            if pair[0] != pair[1]:
                band &= blk[i:hi, None] != blk[None, j:hj]
            x, y = np.nonzero(band)
            if not len(x):
                continue
            if len(x) <= 1000:
                both = np.array([_common(sets[i + p], sets[j + q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
            else:
                both = _products(sets[i:hi], sets[j:hj])[x, y]
            x, y = x + i, y + j
            ok = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
            x, y = x[ok], y[ok]
            np.add.at(links, x, w[y])
            np.add.at(links, y, w[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return links, [find(k) for k in range(n)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _products(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each set of left shares with each of right: 0-1 matrices over so many values at a time."""
    one, two = np.concatenate(left), np.concatenate(right)
    names = np.intersect1d(one, two)
    places = []
    for sets, flat in ((left, one), (right, two)):
        owner, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
        ok = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((owner[ok][order], at[ok][order]))
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(names), columns):
        parts = []
        for sets, (owner, at) in zip((left, right), places, strict=True):
            own = slice(*np.searchsorted(at, [lo, lo + columns]))
            part = np.zeros((len(sets), min(columns, len(names) - lo)), np.float32)
            part[owner[own], at[own] - lo] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _row_key(docs: DataFrame) -> Column:
    """128 bits of a row's id, text, and lang and source where it has them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    own = [text(c) for c in ("lang", "source") if c in docs.columns]
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), *own, F.coalesce("text", F.lit("")))))


def signed_rows(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, row_key, node, bands, grams: staged."""
    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(docs).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(read.mapInArrow(lambda it: _signed(it, bands, rows), "doc_id long, row_key binary, node binary, bands array<long>, grams long"), "minhash")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9995, block: int = 1024, block_grams: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows as signed_rows; nodes with node, class_id, class_node, members (rows), links (linked rows), rep_key (the row that stands for the class, or null)."""
    bands, per = banding(threshold, recall)
    rows = signed_rows(docs, bands, per)
    # the row that stands for a node: least id (nulls last), then least key
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    # rows with one node are one before its bands are dealt out; partial sums leave few rows of a node that many rows have
    nodes = staged(rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min(first).alias("rep"), F.first("bands").alias("bands"), F.first("grams").alias("grams")), "nodes")
    hashes = nodes.select("node", F.explode("bands").alias("band"))
    nodes = nodes.drop("bands")
    buckets = hashes.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root <> last").select("band", "root")
    stars = hashes.join(buckets, "band").where("node <> root").select("node", "root").distinct()
    groups = components(stars)
    # candidates are the nodes of groups with two nodes or more: those that have a root, and the roots
    heads = groups.select(F.col("root").alias("node"), "root").distinct()
    cand = groups.select("node", "root").union(heads).join(nodes, "node").checkpoint()
    sizes = cand.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("grams").alias("all_grams"))
    placed = cand.join(sizes, "root").withColumn("n_blocks", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all_grams") / block_grams), F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).checkpoint()
    texts = docs.select(_row_key(docs).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    # few candidates go to the texts; many meet them by a shuffle
    with_text = texts.join(small(placed.withColumn("row_key", F.col("rep.row_key"))), "row_key").dropDuplicates(["row_key"])
    tasks = with_text.select(
        "root", "node", "members", "block", "n_blocks", "text",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))).alias("pair"),
    ).select("root", "node", "members", "block", "n_blocks", "text", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        mh = MinHash(bands, per)
        links, roots = _verify(pdf["text"].tolist(), pdf["node"].tolist(), pdf["members"].tolist(), pdf["block"].tolist(), (key[1], key[2]), mh, threshold)
        out = pd.DataFrame({"node": pdf["node"], "root": pdf["node"].iloc[roots].to_numpy(), "links": links, "split": (pdf["n_blocks"] > 1).to_numpy()})
        if len(pdf) >= 128:
            give_back()
        return out

    verified = tasks.groupBy("root", "lo", "hi").applyInPandas(verify, "node binary, root binary, links long, split boolean").checkpoint()
    over = components(verified.where("split").select("node", "root"))
    own = verified.where(~F.col("split") & (F.col("node") != F.col("root"))).select("node", "root")
    in_class = own.union(over)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.join(in_class.withColumnRenamed("root", "class_node"), "node", "left").join(links, "node", "left")
    found = found.select("node", "members", "rep", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("links", F.lit(0)).alias("links")).checkpoint()
    reps = found.groupBy("class_node").agg(F.min("rep").alias("class_rep"))
    out = found.join(reps, "class_node")
    out = out.select("node", "class_node", "members", "links", F.col("class_rep.doc_id").alias("class_id"), F.when(F.col("class_rep") == F.col("rep"), F.col("rep.row_key")).alias("rep_key"))
    return rows, out


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9995, block: int = 1024) -> DataFrame:
    """doc_id, class_id (least id of the class), n_links (other rows that the row is linked to): one row for each of docs."""
    rows, nodes = classes(docs, threshold, recall, block)
    return rows.select("doc_id", "node").join(nodes, "node").select("doc_id", "class_id", (F.col("links") + F.col("members") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = 0.9995, block: int = 1024) -> DataFrame:
    """docs without all but one row of each class."""
    _, nodes = classes(docs, threshold, recall, block)
    name = "kept_key"
    while name in docs.columns:
        name += "_"
    kept = nodes.where(F.col("rep_key").isNotNull()).select(F.col("rep_key").alias(name))
    keyed = docs.withColumn(name, _row_key(docs))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
