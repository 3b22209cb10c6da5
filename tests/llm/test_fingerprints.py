"""Invertible Bloom fingerprints against sets of digests."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np

from barwright.llm import fingerprints as fp


def brute(rows):
    out = {}
    order = sorted(rows, key=lambda x: -x[0])
    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, nxt)
    return out


def like(a, b):
    def lines(text):
        seen = Counter()
        return {(p, seen.update([p]) or seen[p]) for p in text.split("\n") if p}

    x, y = lines(a), lines(b)
    size = lambda s: sum(len(p) for p, _ in s)
    return 1 - size(x ^ y) / (size(x) + size(y)) if x or y else 1.0


def test_every_row_against_brute_force(docs, local):
    got = {r["doc_id"]: r for r in fp.chained(docs, 3).collect()}
    want = brute(local)
    assert got.keys() == want.keys()
    seen = {}
    for i, (n, sha, text, edited, nxt) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - like(text, edited)) < 1e-12 and abs(r["near_next"] - like(text, nxt)) < 1e-12
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert seen.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]


def random_keys(rng, n, common=()):
    new = [(rng.getrandbits(64), rng.choice([1, 80, 3_000_000_000])) for _ in range(n)]
    pairs = [*common, *new]
    return np.array([k for k, _ in pairs], np.uint64), np.array([s for _, s in pairs], np.uint64)


def pairs_of(keys):
    return list(zip(*(x.tolist() for x in keys), strict=True))


def test_peeling_recovers_planted_differences():
    rng = random.Random(1)
    a = [random_keys(rng, rng.choice([0, 1, 5, 3000])) for _ in range(40)]
    b = [random_keys(rng, rng.choice([0, 2, 900]), pairs_of(x)[: len(x[0]) // 2]) for x in a]
    count, length, _ = fp.differences(a, b)
    apart = [set(pairs_of(x)) ^ set(pairs_of(y)) for x, y in zip(a, b, strict=True)]
    assert count.tolist() == [len(x) for x in apart] and length.tolist() == [sum(s for _, s in x) for x in apart]


def test_published_tables_fold_and_peel():
    """What fingerprints hold is enough: folded to one size, subtracted and peeled, they tell versions apart."""
    rng, stalled = random.Random(2), 0
    for _ in range(200):
        one = random_keys(rng, rng.randint(10, 90))
        two = random_keys(rng, rng.randint(1, 8), pairs_of(one)[: len(one[0]) - rng.randint(1, 8)])
        x, y = map(fp.table_of, fp.fingerprint_of([one, two]))
        w = min(len(x[0]), len(y[0])) // 3
        small, other = fp.folded(x, w), fp.folded(y, w)
        for keys, t in ((one, small), (two, other)):
            assert all((p[0] == q).all() for p, q in zip(fp.sketches(np.zeros(len(keys[0]), int), *keys, 1, w), t, strict=True))
        n, size, ok = fp.peel(small[0][None] - other[0], *((p ^ q)[None] for p, q in zip(small[1:], other[1:], strict=True)))
        apart = set(pairs_of(one)) ^ set(pairs_of(two))
        stalled += not ok[0]
        assert not ok[0] or (n[0], size[0]) == (len(apart), sum(s for _, s in apart))
    assert stalled <= 10


def test_larger_tables_end_every_stall():
    rng = random.Random(3)
    a, b = ([random_keys(rng, n) for n in (1, 2, 40, 500)] for _ in range(2))
    count, _, stalled = fp.differences(a, b)
    assert count.tolist() == [2, 4, 80, 1000] and stalled >= 1
    same = (np.array([7, 7], np.uint64), np.array([1, 2], np.uint64))  # one digest for two lengths
    assert fp.differences([same], [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))])[0].tolist() == [2]


def test_paragraphs_are_lines_and_have_digests_of_their_own():
    keys, sizes = fp.digests("a.\n\na. b.\na.\na.")
    assert sizes.tolist() == [2, 5, 2, 2] and len(set(keys.tolist())) == 4 and len(fp.digests("")[0]) == 0
    assert len(fp.digests("one line, however long. " * 5000)[0]) == 1


def test_fingerprints_are_smaller_than_texts(docs):
    rows = fp.chained(docs, 3).collect()
    assert sum(len(r["fingerprint"]) for r in rows) < 0.5 * sum(r["n_chars"] for r in rows)


def test_odd_rows(odd):
    got = fp.chained(odd, 2).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fp.chained(odd.limit(0)).count() == 0
