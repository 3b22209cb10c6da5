"""Quality rules by robust multivariate outliers.

Every document gets a vector of transformed statistics. For each language and source a minimum-covariance-determinant
estimate of centre and scatter is fitted on all its rows. Three starts are made of moments over all rows (the identity,
the scatter of tanh scores, the scatter of spatial signs, all around the medians). A concentration step keeps the share
``support`` of rows with the least Mahalanobis distance and takes their moments anew. After two steps of each start the
one with the least determinant goes on until its determinant stops falling. The scatter is made consistent for normal
rows by the usual factor, and the squares of ``FEATURES``' tolerances are added to its diagonal (the target of a
regularized determinant), so that a statistic that is constant in most texts doesn't reject by a trifle. A document is
rejected when its squared distance passes the chi-square quantile of ``1 - false_share`` (the added tolerances make this
a bound: fewer normal rows than that are rejected), or by the base rules. Groups with fewer than ``min_group`` rows are
held against an estimate fitted on all rows of their language or, if that is small too, on all rows of the corpus.

Nulls: a null text is empty; null lang and source are groups of their own, other than the empty string's. An empty table
gives an empty result. Repeated rows are judged one by one. Other columns are passed through untouched if asked for; a
column of the input that clashes with a result column is dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, sliced, small, staged, string_list

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Name and tolerance (a difference that by itself says nothing of a text): sizes by a factor of two, shares by what a text of some dozen words scatters.
FEATURES = {"x_word_len": 0.10, "x_words": 0.70, "x_symbols": 0.04, "x_dup_lines": 0.12, "x_repeats": 0.14, "x_distinct": 0.10, "x_digits": 0.25, "x_line_len": 0.60}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[str], width: int = 5) -> int:
    """How many words lie in windows of that width found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * _MIX + ids[k : k + n] + np.uint64(1)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_statistics(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct words, digits, lines with a word."""
    words = WORD.findall(text)
    chars = len("".join(words))
    symbols = sum(map(text.count, SYMBOLS))
    digits = sum(map(text.count, "0123456789"))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words), len(set(words)), digits, lines


def _vectors(raw: np.ndarray) -> np.ndarray:
    """The transformed statistics: logarithms of sizes, arcsines of the roots of shares."""
    words, chars, symbols, dup, repeat, distinct, digits, lines = raw.T.astype(float)
    w, c, li = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    return np.stack([np.log(c / w), np.log1p(words), share(symbols, c), share(dup, li), share(repeat, w), share(distinct, w), share(digits, c), np.log(w / li)], axis=1)


def _measure(batches: Iterator[pa.RecordBatch], extra: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, text):
        raw = np.array([text_statistics(t) for t in string_list(batch.column(text))], np.int64).reshape(-1, 8)
        x = _vectors(raw)
        cols = [batch.column(c) for c in extra] + [pa.array(raw[:, i]) for i in range(5)] + [pa.array(x[:, i]) for i in range(x.shape[1])]
        yield pa.RecordBatch.from_arrays(cols, names=[*extra, *COUNTS, *FEATURES])


def measured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Statistics of each row's text beside the columns in keep, lang and source (as k_lang, k_source), staged. keep has no name of these."""
    ship(docs.sparkSession)
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  null is "-", which no text is
    read = docs.select(*[F.col(c) for c in keep], group("lang").alias("k_lang"), group("source").alias("k_source"), *([] if text in keep else [F.col(text)]))
    keep = [*keep, "k_lang", "k_source"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*keep).schema] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])
    return staged(read.mapInArrow(lambda it: _measure(it, keep, text), schema), "quality")


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        term = term * x / 2 / k if k else 1.0
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return low


def consistency(support: float, degrees: int) -> float:
    """What the scatter of the nearest share of normal rows is multiplied by to be the scatter of all."""
    return support / chi_square(chi_square_quantile(support, degrees), degrees + 2)


P = len(FEATURES)
KEYS = ["g_lang", "g_source", "start"]
MODEL = "g_lang string, g_source string, start int, determinant double, fall double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"p{i}_{j} double" for i in range(P) for j in range(i, P)])


def _model(keys: list, centre: np.ndarray, scatter: np.ndarray, before: float = math.inf) -> list:
    """A row of MODEL; before: the logarithm of the determinant that the step began with."""
    precision, now = np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])
    return [*keys, now, before - now, *centre, *precision[np.triu_indices(P)]]


def _square(r: dict, name: str) -> np.ndarray:
    out = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            out[i, j] = out[j, i] = r[f"{name}{i}_{j}"]
    return out


def _solve(batches: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Moments of each group's nearest rows to centre, inverse scatter and logarithm of its determinant."""
    names = [x.split()[0] for x in MODEL.split(", ")]
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            cov = (_square(r, "q") / r["n"] - np.outer(mean, mean)) * factor
            out.append(_model([r[k] for k in KEYS], mean, cov + np.diag([r[f"v{i}"] for i in range(P)]), r["before"]))
        yield pd.DataFrame(out, columns=names)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three starts of each group around its medians (0 in the scaled statistics)."""
    names = [x.split()[0] for x in MODEL.split(", ")]
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            floor = np.diag([r[f"v{i}"] for i in range(P)])
            for k, scatter in enumerate((np.eye(P), _square(r, "t") / r["n"] + floor, _square(r, "u") / r["n"] + floor)):
                out.append(_model([r["g_lang"], r["g_source"], k], np.zeros(P), scatter))
        yield pd.DataFrame(out, columns=names)


def _distance(names: list[str]) -> F.Column:
    d = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(names)]
    return sum((F.col(f"p{i}_{j}") * d[i] * d[j] * F.lit(1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)), F.lit(0.0))


def _products(cols: list, name: str) -> list:
    return [F.sum(cols[i] * cols[j]).alias(f"{name}{i}_{j}") for i in range(P) for j in range(i, P)]


def estimates(fitted: DataFrame, support: float = 0.75, tolerance: float = 0.01, steps: int = 40) -> tuple[DataFrame, DataFrame]:
    """(scales, model): each group's medians t and scales w of the statistics, and its estimate of the scaled ones.

    fitted: g_lang, g_source and the statistics. tolerance: a fall of the logarithm of the determinant that is none (quantiles are sketched within 0.1 %).
    steps: an estimate that still falls after so many steps is taken as it is. One whose determinant would rise stays as it was.
    """
    names, group = list(FEATURES), ["g_lang", "g_source"]
    spread = lambda i: (F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349  # noqa: E731  a normal row's deviation by the quartiles
    quartiles = fitted.groupBy(*group).agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"c{i}") for i, c in enumerate(names)])
    width = [F.sqrt(F.pow(spread(i), F.lit(2.0)) + t**2) for i, t in enumerate(FEATURES.values())]
    scales = quartiles.select(*group, *[F.col(f"c{i}")[1].alias(f"t{i}") for i in range(P)], *[w.alias(f"w{i}") for i, w in enumerate(width)], *[(F.lit(t**2) / (w * w)).alias(f"v{i}") for i, (t, w) in enumerate(zip(FEATURES.values(), width, strict=True))]).checkpoint()
    rows = staged(fitted.join(small(scales), group).select(*group, *[f"v{i}" for i in range(P)], *[((F.col(c) - F.col(f"t{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i, c in enumerate(names)]), "scaled")
    z = [f"z{i}" for i in range(P)]
    norm = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))), F.lit(1e-9))
    first = [F.first(f"v{i}").alias(f"v{i}") for i in range(P)]
    n = F.count(F.lit(1)).cast("double").alias("n")
    around = rows.groupBy(*group).agg(n, *first, *_products([F.tanh(c) for c in z], "t"), *_products([F.col(c) / norm for c in z], "u"))
    model = around.mapInPandas(_starts, MODEL).checkpoint()
    factor = consistency(support, P)

    def step(model: DataFrame) -> DataFrame:
        near = rows.join(small(model), group).withColumn("d2", _distance(z))
        cut = near.groupBy(*KEYS).agg(F.percentile_approx("d2", F.lit(support), 1000).alias("cut")).checkpoint()
        kept = near.join(small(cut), KEYS).where("d2 <= cut")
        moments = kept.groupBy(*KEYS).agg(n, *first, F.first("determinant").alias("before"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(z)], *_products([F.col(c) for c in z], "q"))
        return moments.mapInPandas(lambda it: _solve(it, factor), MODEL).checkpoint()

    for _ in range(2):
        model = step(model)
    least = model.groupBy(*group).agg(F.min(F.struct("determinant", "start")).alias("best")).select(*group, F.col("best.start").alias("start"))
    model = model.join(least, KEYS, "left_semi").checkpoint()
    done = model.where(F.col("fall") <= tolerance)
    for _ in range(steps):
        going = model.where(F.col("fall") > tolerance)
        if not going.take(1):
            return scales, done
        model = step(going)
        rose = going.join(model.where("fall < 0").select(*KEYS), KEYS, "left_semi").select(*going.columns)
        done = done.union(model.where((F.col("fall") >= 0) & (F.col("fall") <= tolerance))).union(rose)
    return scales, done.union(model.where(F.col("fall") > tolerance))


def judged(docs: DataFrame, keep: list[str], support: float = 0.75, false_share: float = 1e-9, min_group: int = 200) -> DataFrame:
    """The columns in keep with counts, base_failed, kept and distance.

    support: share of a group's rows that its estimate rests on. false_share: share of normal rows that may be rejected.
    min_group: rows that an estimate of its own needs.
    """
    results = [*COUNTS, "base_failed", "kept", "distance"]
    keep = [c for c in dict.fromkeys(keep) if c not in results]
    # what passes through goes under other names, so that no column of the input meets one of the fit
    back = {f"passed_{k}__": c for k, c in enumerate(keep)}
    text = next((n for n, c in back.items() if c == "text"), "text")
    docs = docs.select(*[F.col(c).alias(n) for n, c in back.items()], "lang", "source", *(["text"] if text == "text" else []))
    rows = measured(docs, list(back), text)
    sizes = rows.groupBy("k_lang", "k_source").agg(F.count(F.lit(1)).alias("size"))
    langs = sizes.groupBy("k_lang").agg(F.sum("size").alias("lang_size"))
    groups = sizes.join(langs, "k_lang").select(
        "k_lang", "k_source",
        F.when((F.col("size") >= min_group) | (F.col("lang_size") >= min_group), F.col("k_lang")).otherwise("*").alias("g_lang"),
        F.when(F.col("size") >= min_group, F.col("k_source")).otherwise("*").alias("g_source"),
    ).checkpoint()
    # what each group's rows are fitted into: their own estimate, their language's and the corpus's, as far as some group needs it
    levels = F.array(*[F.struct(a.alias("g_lang"), b.alias("g_source")) for a, b in ((F.col("k_lang"), F.col("k_source")), (F.col("k_lang"), F.lit("*")), (F.lit("*"), F.lit("*")))])
    fits = groups.select("k_lang", "k_source", F.inline(levels)).distinct().join(groups.select("g_lang", "g_source").distinct(), ["g_lang", "g_source"], "left_semi").checkpoint()
    fitted = rows.select("k_lang", "k_source", *FEATURES).join(small(fits), ["k_lang", "k_source"])
    scales, model = estimates(fitted, support)
    found = small(groups.join(scales, ["g_lang", "g_source"]).join(model, ["g_lang", "g_source"]).drop("g_lang", "g_source", "start").checkpoint())
    scaled = [f"z{i}" for i in range(P)]
    near = rows.join(found, ["k_lang", "k_source"]).withColumns({c: (F.col(f) - F.col(f"t{i}")) / F.col(f"w{i}") for i, (c, f) in enumerate(zip(scaled, FEATURES, strict=True))})
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = near.withColumn("d2", _distance(scaled)).withColumns({"base_failed": base, "distance": F.sqrt(F.greatest("d2", F.lit(0.0)))})
    limit = chi_square_quantile(1 - false_share, P)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= limit))
    return out.select(*back, *COUNTS, "base_failed", "kept", "distance").withColumnsRenamed(back)
