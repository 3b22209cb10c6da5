"""Quality rules: base counts by brute force, outliers by planted rows."""

import re
from collections import Counter

import numpy as np

from barwright.llm import quality


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            inside.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_every_row_against_brute_force(docs, local):
    got = {r["doc_id"]: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert len(got) == len(local)
    for i, text in local:
        want, r = base(text), got[i]
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in got.values()) >= 0.9 * sum(not r["base_failed"] for r in got.values())


def test_outliers_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(4)
    words = [f"w{'abcdefghij'[k % 10] * (1 + k % 7)}{'klmnop'[k % 6]}{k:x}" for k in range(800)]
    text = lambda: " ".join(rng.choice(words, rng.integers(60, 200))) + ".\n" + " ".join(rng.choice(words, 40))
    rows = [(i, text(), "en", "hot" if i < 900 else "small") for i in range(1000)]
    rows += [(2000 + i, " ".join(f"#{k}|%$&*<>" for k in range(40 + i)), "en", "hot") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(df, ["doc_id"], min_group=200).collect()}
    assert not any(kept[2000 + i] for i in range(30)) and all(kept[i] for i in range(1000))


def test_small_groups_are_held_against_all_rows(spark):
    rng = np.random.default_rng(4)
    words = [f"w{'abcdefghij'[k % 10] * (1 + k % 7)}{'klmnop'[k % 6]}{k:x}" for k in range(800)]
    text = lambda: " ".join(rng.choice(words, rng.integers(60, 200))) + ".\n" + " ".join(rng.choice(words, 40))
    junk = lambda i: " ".join(f"#{k}|%$&*<>" for k in range(40 + i))
    rows = [(i, text(), "en", "hot") for i in range(400)] + [(400, text(), "en", "small"), (401, text(), None, None)]
    rows += [(2000 + i, junk(i), "en", "junk") for i in range(3)] + [(2003, junk(3), "rare", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(df, ["doc_id"], min_group=200).collect()}
    assert len(kept) == len(rows) and not any(kept[2000 + i] for i in range(4)) and all(kept[i] for i in range(402))


def fitted(x, support=0.75):
    """The estimate in numpy, with exact quantiles: squared distances of all rows."""
    floor = np.array(list(quality.FEATURES.values()))
    low, mid, high = np.percentile(x, [25, 50, 75], axis=0, method="lower")
    width = np.sqrt(((high - low) / 1.349) ** 2 + floor**2)
    z, target = (x - mid) / width, np.diag(floor**2 / width**2)
    t, u = np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    q = quality.chi_square_quantile(support, 8)
    factor = support / quality.chi_square(q, 10)
    away = lambda m, k: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(k), z - m)
    best = None
    for k in (np.eye(8), t.T @ t / len(z) + target, u.T @ u / len(z) + target):
        m, before = np.zeros(8), np.inf
        while True:
            d = away(m, k)
            near = z[d <= np.quantile(d, support, method="lower")]
            m, k = near.mean(axis=0), np.cov(near.T, bias=True) * factor + target
            now = np.linalg.slogdet(k)[1]
            if before - now <= 1e-6:
                break
            before = now
        if best is None or now < best[0]:
            best = (now, m, k)
    return away(*best[1:])


def test_verdicts_against_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang").toPandas()
    x = quality._vectors(np.array([quality.text_statistics(t or "") for t in rows["text"]], np.int64))
    want = {}
    for lang in rows["lang"].unique():
        at = np.flatnonzero(rows["lang"] == lang)
        # no language and source has as many rows, so that a language's rows, or else all, are the group
        d2 = fitted(x[at]) if len(at) >= 150 else fitted(x)[at]
        want |= dict(zip(rows["doc_id"].to_numpy()[at].tolist(), d2.tolist(), strict=True))
    limit = quality.chi_square_quantile(1 - 1e-9, 8)
    got = quality.judged(docs, ["doc_id"], min_group=150).collect()
    assert len(got) == len(want)
    for r in got:
        d2 = want[r["doc_id"]]
        assert abs(r["distance"] ** 2 - d2) <= 0.05 * d2 + 0.05
        if abs(d2 - limit) > 0.06 * limit:
            assert r["kept"] == (not r["base_failed"] and d2 <= limit)


def test_chi_square_and_consistency():
    assert abs(quality.chi_square_quantile(0.5, 8) - 7.344) < 1e-3 and abs(quality.chi_square_quantile(0.999, 8) - 26.124) < 1e-3
    x = np.random.default_rng(1).standard_normal((200_000, 8))
    d = (x * x).sum(axis=1)
    near = x[d <= np.quantile(d, 0.75)]
    assert abs(near.var(axis=0).mean() * quality.consistency(0.75, 8) - 1) < 0.01


def test_columns_that_clash_with_inner_names(docs):
    from pyspark.sql import functions as F

    names = ["m0", "t0", "w0", "p0_0", "cut", "count", "size", "lang_size", "g_lang", "g_source", "k_lang", "k_source", "start", "determinant", "d2", "z0", "distance", "kept", "base_failed", "n_words"]
    some = docs.limit(60).select("*", *[F.lit(7).alias(n) for n in names])
    got = quality.judged(some, ["doc_id", *names])
    assert len(set(got.columns)) == len(got.columns) and got.count() == 60
    assert got.where("m0 = 7 AND t0 = 7 AND cut = 7 AND g_lang = 7 AND k_lang = 7 AND determinant = 7 AND z0 = 7").count() == 60


def test_null_and_empty_groups_differ(spark):
    rows = [(1, "a b c", None, None), (2, "a b c", "", ""), (3, "a b c", "*", "*")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.measured(df, ["doc_id"], "text").select("k_lang", "k_source").distinct().count() == 3
    assert quality.judged(df, ["doc_id"]).count() == 3


def test_odd_rows(odd):
    got = quality.judged(odd, ["doc_id", "text", "lang", "source", "n_chars"])
    assert got.count() == odd.count() and quality.judged(odd.limit(0), ["doc_id"]).count() == 0
    assert got.where("text IS NULL AND kept").count() == 0
