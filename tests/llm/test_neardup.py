"""N-gram Jaccard join against all pairs."""

import re
from collections import Counter

import pytest

from barwright.llm import neardup


def grams(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (both >= 0.8 * (len(a) + len(b) - both) and both) or (not a and not b):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    ids = {}
    for i in range(n):
        if rows[i][0] is not None:
            ids[find(i)] = min(ids.get(find(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], ids.get(find(i)), links[i]) for i in range(n))


@pytest.mark.parametrize("block", [1024, 4])
def test_every_row_against_all_pairs(docs, local, block):
    got = neardup.joined(docs, block=block)
    assert Counter(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute(local)


def test_chain_of_near_copies(spark):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        words = words.copy()
        words[i * 4] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.joined(df, block=16)
    assert Counter(map(tuple, got.collect())) == brute(rows)
    kept = [r["doc_id"] for r in neardup.one_of_each(df, block=16).collect()]
    assert kept == [0]


def test_banding_reaches_recall():
    bands, rows = neardup.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert Counter(map(tuple, neardup.joined(odd).collect())) == brute(rows)
    one = neardup.one_of_each(odd)
    assert one.columns == odd.columns and one.count() == len({c for _, c, _ in brute(rows)})
    assert neardup.joined(odd.limit(0)).count() == 0 and neardup.one_of_each(odd.limit(0)).count() == 0


def test_rows_of_one_id_and_text_keep_the_same_row(spark):
    """Rows that differ in lang or source alone: which one stays doesn't depend on their order."""
    rows = [(1, "one two three four five six seven", lang, source, 33) for lang in ("en", "de", None) for source in ("a", "b", None)]
    kept = set()
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        got = neardup.one_of_each(spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).collect()
        assert len(got) == 1
        kept.add((got[0]["lang"], got[0]["source"]))
    assert len(kept) == 1
