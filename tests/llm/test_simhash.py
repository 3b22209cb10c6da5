"""Fingerprints and components against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barwright.llm import queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(prints, radius=2):
    """fingerprint: least fingerprint of its component."""
    prints, parent = sorted(set(prints)), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in prints}


def expected(rows):
    prints = [plain(t) for _, t in rows]
    root = brute(prints)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints, strict=True)), key=str)


def test_query(spark, sf, local):
    got = queries.op12_simhash_components(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(local)


def test_fingerprint_in_parts():
    rng = random.Random(3)
    text = " ".join(rng.choice(["Über", "a", "B c", "É", "x" * 50]) for _ in range(1000))
    assert simhash.fingerprint(text) == simhash.fingerprint(text, part=7) == plain(text)
    assert [simhash.fingerprint(t) for t in ("", " \t\n", "One", "one  TWO")] == [plain(t) for t in ("", " ", "one", "one two")]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 3), replace=False))) for b in base for _ in range(25)], np.uint64)
    n = len(prints)
    start, stop = np.arange(n) + 1, np.minimum(np.arange(n) + 170, n)
    got = {(int(i), int(j)) for a, b in simhash.linked(prints, start, stop, radius, most=97) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(start[i], stop[i]) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}


def test_blocks_lose_no_link(spark):
    """One bucket of many blocks, chains of links, far fingerprints, the highest bit."""
    rng = random.Random(5)
    prints = {1 << a | 1 << b for a in range(64) for b in range(a, 64, 5)} | {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**64 - 2}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    for block, bands in ((4096, 4), (50, 3), (16, 5)):
        edges = [(r["node"] % 2**64, r["root"] % 2**64) for r in simhash.links(nodes, 2, bands, block).collect()]
        assert all((a ^ b).bit_count() <= 2 * len(prints) for a, b in edges)
        parent = {p: p for p in prints}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {p: find(p) for p in prints} == brute(prints)


def test_odd_rows(odd, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = simhash.grouped(odd)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    assert simhash.grouped(odd.limit(0)).count() == 0
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    assert {(r["component_id"]) for r in simhash.grouped(copies).collect()} == {0}
    with pytest.raises(ValueError):
        simhash.grouped(odd, radius=4, bands=4)
