"""Collocations against SQL and plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from barwright.llm import collocations as co
from barwright.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, share, top):
    """Every phrase counted in Python. rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            cuts = [(2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= share * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def collected(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_sql(spark, sf, duck):
    got = collected(queries.op11_collocations(spark, sf))
    assert got and got == sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({co.oracle()})").fetchall())


def texts(seed=4):
    rng, words = random.Random(seed), ["new", "New", "york", "a", "É", " x", "\x00", "b c", "sea-side", "日本", "𝄞"]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r\n", ":"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "und", None, ""]), rng.choice([text, text, text * 3, " the the the the the" * 3, None, "", " . "])))
    return rows


@pytest.mark.parametrize(("least", "share", "top", "bits"), [(30, 80, 2000, 28), (3, 50, 7, 28), (5, 80, 2000, 16)])
def test_matches_plain_counts(spark, least, share, top, bits):
    rows = texts()
    df = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, lang string, text string, rank long, phrase string").repartition(5)
    want = plain(rows, least, share, top)
    assert want and collected(co.mined(df, least, share, top, bits)) == want
    con, pdf = duckdb.connect(), df.toPandas()  # noqa: F841  DuckDB finds it by name
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({co.oracle('pdf', least, share, top)})").fetchall()) == want


def test_full_sketch_loses_nothing():
    """Sketches that admit everything give the same counts as ones that admit what is frequent."""
    text = co.normalized(" ".join(random.Random(2).choices(["a", "b", "c."], k=5000)))
    full = co.Sketch(16, np.full(1 << 14, 255, np.uint8))
    n, found = co.counted(text, "en", full, full)
    words = [p.split() for p in text.decode().split("\n")]
    want = Counter(" ".join(w[i : i + k]) for w in words for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == dict(want) and n == sum(map(len, words))


def test_chunks_keep_every_run():
    rng = random.Random(9)
    text = co.normalized("".join(rng.choice(["w" * rng.randrange(1, 40), "é", "x.", "\n"]) + " " for _ in range(800)))
    runs = lambda t: {t[s[i] : e[i + k]] for s, e, r in [co.grams(t, 1)] for k, (g, ok) in enumerate(r) for i in np.flatnonzero(ok)}
    for size in (1, 50, 333, 10**6):
        got = set()
        for part in co.chunks(text, size):
            got |= runs(part)
        assert got == runs(text)
    assert b"".join(co.chunks(co.normalized("x" * 5000), 100)) == co.normalized("x" * 5000)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the score's decimals."""
    from pyspark.sql import functions as F

    a, total = 9 * 10**17, 9 * 10**17 + 7 * 10**17
    expr = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    df = spark.createDataFrame([(a, 9 * 10**17, 7 * 10**17)], "a long, l long, r long")
    assert df.select(F.expr(expr).alias("s")).first()["s"] == 2_000_000 * a // total


def test_odd_rows(odd):
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert collected(co.mined(odd, least=2)) == plain(rows, 2, 80, 2000)
    assert co.mined(odd.limit(0)).count() == 0
