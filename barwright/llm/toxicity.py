"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (counts of fixed size, summed by Spark).
2. Stretches of a text that look disguised (digits or signs after letters or before a word, a letter three times
   running, letters doubled one after the other, single letters and signs set apart by one to three separators) are lattices: each character may stand for itself, for letters it is a picture of, or for nothing
   (a separator, a repeated letter). Viterbi finds the likeliest letters under channel and trigram model.
3. The restored text's character n-grams (4 to 7) are scored by a logistic regression on those n-grams that tell the
   labels apart best, fitted on a bounded sample of labelled rows.

Inputs of a score are texts alone. Nulls: a null text is empty and gets the score that no n-gram gives; a null id is
not held out. Repeated rows are scored each. An id with several labels is toxic if one of them says so, and its text is
the least of its rows'; a null label is none. Without labels, or with labels of one kind, every score is the share of
toxic labels. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, sliced, string_list

#: Letters with an id of their own; 0 is anything that isn't a letter, the last is any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))) + "œąćęłńśźżčďěňřšťůžğışőű"
SIZE = len(LETTERS) + 2
#: What a character may be a picture of (fixed values).
PICTURES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = frozenset(" .-_*'`~,/\\")
#: Three or more letters or signs, each one apart.
APART = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{re.escape(''.join(PICTURES))}])(?:[{re.escape(''.join(sorted(SEPARATORS)))}]{{1,3}}(?:[^\W_]|[{re.escape(''.join(PICTURES))}])){{2,}}(?![^\W_])")
GRAMS, BITS = (4, 5, 6, 7), 21
_MASK = np.uint64((1 << BITS) - 1)


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Letter ids of code points below 2^16, and marks: 1 for signs of PICTURES."""
    ids = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        low = chr(c).lower()
        if len(low) == 1 and low.isalpha():
            ids[c] = LETTERS.find(low) + 1 or SIZE - 1
    signs = np.zeros(1 << 16, bool)
    for c in PICTURES:
        signs[ord(c)] = True
    return ids, signs


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a blank before, between and after, the letter ids, and each text's first place."""
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    ids = _codes()[0][np.minimum(raw, 0xFFFF)]
    return raw, ids, starts


def trigram_counts(texts: list[str]) -> np.ndarray:
    _, ids, _ = _stream(texts)
    x = ids.astype(np.int32)
    x = x[np.concatenate([[True], (x[1:] > 0) | (x[:-1] > 0)])]  # runs of other characters are one border
    return np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over all documents, smoothed by the bigram and the letter; SIZE^3 numbers whatever the corpus."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in sliced(batches, "text", 500_000):
            total += trigram_counts(string_list(b.column("text")))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros(SIZE**3)
    c[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    c = c.reshape(SIZE, SIZE, SIZE)
    two, one = c.sum(axis=0), c.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 50 * p1) / (two.sum(axis=1, keepdims=True) + 50)
    return np.log((c + 20 * p2[None]) / (c.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


def decode(window: str, lm: np.ndarray) -> str:
    """The likeliest letters of a disguised stretch: Viterbi over pairs of letters."""
    at = {c: k + 1 for k, c in enumerate(LETTERS)}
    states: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, -1)}
    # what was written on the way: a letter and the place of the one before, so that a long stretch costs no more a character
    written: list[tuple[str, int]] = []
    before = ""
    for ch in window.lower():
        options: list[tuple[str, float]] = []
        if ch in at:
            options.append((ch, 0.0))
            if ch == before:
                options.append(("", -0.7))
        elif ch.isalpha():
            options.append((ch, 0.0))
        else:
            options += [(c, -1.5) for c in PICTURES.get(ch, "")]
            if ch in SEPARATORS or ch in PICTURES:
                options.append(("", -1.0 if ch in SEPARATORS else -3.0))
            if not options:
                options.append((" ", -2.0))
        before = ch
        new: dict[tuple[int, int], tuple[float, str, int]] = {}
        for (a, b), (score, last) in states.items():
            for c, cost in options:
                if not c:
                    key, s = (a, b), score + cost
                else:
                    k = at.get(c, SIZE - 1 if c.isalpha() else 0)
                    key, s = (b, k), score + cost + float(lm[a, b, k])
                if key not in new or s > new[key][0]:
                    new[key] = (s, c, last)
        states = {}
        for key, (s, c, last) in new.items():
            if c:
                written.append((c, last))
                last = len(written) - 1
            states[key] = (s, last)
    if not states:
        return window
    _, last = max((s + float(lm[a, b, 0]), last) for (a, b), (s, last) in states.items())
    out = []
    while last >= 0:
        c, last = written[last]
        out.append(c)
    return "".join(reversed(out))


def windows(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Disguised stretches of each text, as code points."""
    raw, ids, starts = _stream(texts)
    letter = ids > 0
    sign = _codes()[1][np.minimum(raw, 0xFFFF)]
    n = len(raw)
    hot = np.zeros(n, bool)
    # a sign after a letter, or before letters at the start of a word
    hot[1:-1] |= sign[1:-1] & (letter[:-2] | (letter[2:] & (sign[:-2] | (raw[:-2] <= 32))))
    # a letter three times
    hot[:-2] |= letter[:-2] & (ids[:-2] == ids[1:-1]) & (ids[1:-1] == ids[2:])
    # letters doubled one after the other: two at the start of a word, three anywhere
    twice = np.zeros(n + 4, bool)
    twice[: n - 1] = letter[:-1] & (ids[:-1] == ids[1:])
    hot[1:] |= twice[1:n] & twice[3 : n + 2] & (~letter[:-1] | twice[5 : n + 4])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for o, text in enumerate(texts):
        out[o] = [m.span() for m in APART.finditer(text) if any(map(str.isalpha, m[0]))]
    places = np.flatnonzero(hot)
    owner = np.searchsorted(starts, places, side="right") - 1
    last, end = -1, 0
    for p, o in zip(places.tolist(), owner.tolist(), strict=True):
        if not 0 <= o < len(texts):
            continue
        k = p - int(starts[o])
        if o == last and k < end:
            continue
        last, end = o, k + 1
        while end < len(texts[o]) and not texts[o][end].isspace():
            end += 1
        out[o].append((k, end))
    return [_whole(text, spans) for text, spans in zip(texts, out, strict=True)]


def _whole(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened to blanks; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and hi <= out[-1][1]:
            continue
        at = out[-1][1] if out else 0
        while lo > at and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if out and lo <= at:
            out[-1] = (out[-1][0], max(hi, at))
        else:
            out.append((lo, hi))
    return out


def restored(texts: list[str], lm: np.ndarray, part: int = 200) -> list[str]:
    out = []
    memo: dict[str, str] = {}
    for at in range(0, len(texts), part):
        some = texts[at : at + part]
        out += [_restored(text, spans, lm, memo) for text, spans in zip(some, windows(some), strict=True)]
    return out


def _restored(text: str, spans: list[tuple[int, int]], lm: np.ndarray, memo: dict[str, str]) -> str:
    if not spans:
        return text
    parts, at = [], 0
    for lo, hi in spans:
        w = text[lo:hi]
        if w not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[w] = decode(w, lm)
        parts += [text[at:lo], memo[w]]
        at = hi
    return "".join([*parts, text[at:]])


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each place of the letter stream, and for each length the n-gram's bucket there (-1: none)."""
    _, ids, starts = _stream(texts)
    keep = np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])
    # an n-gram is its second letter's: the border that it may begin with can be of the text before
    owner = np.searchsorted(starts, np.flatnonzero(keep), side="right") - 1
    owner = np.append(owner[1:], owner[-1:])
    x = ids[keep].astype(np.uint64)
    n = len(x)
    zero = np.concatenate([[0], np.cumsum(x == 0)])
    out, h = [], np.zeros(n, np.uint64)
    for k in range(max(GRAMS)):
        m = n - k
        if m <= 0:
            break
        h[:m] = h[:m] * np.uint64(0x9E3779B97F4A7C15) + x[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            # no border inside
            inside = zero[k : n] - zero[1 : m + 1] if k else np.zeros(m, np.int64)
            mixed = h[:m] ^ (h[:m] >> np.uint64(32))
            bucket = (((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & _MASK).astype(np.int64)
            bucket[inside > 0] = -1
            out.append(bucket)
    return owner, out


def hits(texts: list[str], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct n-gram bucket that is used."""
    owner, buckets = grams(texts)
    found = []
    for b in buckets:
        ok = np.flatnonzero((b >= 0) & used[b])
        found.append(owner[ok].astype(np.int64) << BITS | b[ok])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], y: np.ndarray, prior: float, features: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept: the most telling n-grams by their log-likelihood ratio, logistic regression."""
    n_pos, n_neg = float(y.sum()), float(len(y) - y.sum())
    if not n_pos or not n_neg:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    every = np.ones(1 << BITS, bool)
    for k in range(0, len(texts), 100):
        t, b = hits(texts[k : k + 100], every)
        own = y[k : k + 100][t] > 0
        pos += np.bincount(b[own], minlength=1 << BITS)
        neg += np.bincount(b[~own], minlength=1 << BITS)
    part = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0)
    both = pos + neg
    rate = both / len(y)
    g2 = part(pos, rate * n_pos) + part(n_pos - pos, (1 - rate) * n_pos) + part(neg, rate * n_neg) + part(n_neg - neg, (1 - rate) * n_neg)
    g2[(both < 5) | (pos / n_pos <= neg / n_neg)] = 0
    top = np.argsort(-g2, kind="stable")[:features]
    top = top[g2[top] > 8]
    used = np.zeros(1 << BITS, bool)
    used[top] = True
    column = np.full(1 << BITS, -1)
    column[top] = np.arange(len(top))
    rows, cols = [], []
    for k in range(0, len(texts), 100):
        t, b = hits(texts[k : k + 100], used)
        rows.append(t + k)
        cols.append(column[b])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    # rows count so that toxic ones have their share in the corpus
    weight = np.where(y > 0, prior / (n_pos / len(y)), (1 - prior) / (n_neg / len(y)))
    w, b0 = np.zeros(len(top)), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    m1, m2 = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for r in range(1, rounds + 1):
        z = b0 + np.bincount(rows, w[cols], len(y))
        diff = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight
        g = np.append(np.bincount(cols, diff[rows], len(top)) / len(y) - 2e-4 * w, diff.mean())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
        w, b0 = w + step[:-1], b0 + float(step[-1])
    table = np.zeros(1 << BITS, np.float32)
    table[top] = w
    return table, b0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_restored int"


def scored(docs: DataFrame, labels: DataFrame, sample: int = 2500, features: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_restored. sample: most labelled rows of either kind that are learned from."""
    spark = docs.sparkSession
    ship(spark)
    lm = language_model(docs)
    learn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    shares = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    prior = (shares["t"] or 0) / shares["n"] if shares["n"] else 0.0
    order = F.struct(F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    drawn = [r[0] for kind in (0, 1) for r in known.where(F.col("toxic") == kind).orderBy(order).limit(sample).select("doc_id").collect()]
    chosen = known.where(F.col("doc_id").isin(drawn) if drawn else F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(drawn) if drawn else F.lit(False)).groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().merge(chosen.toPandas(), on="doc_id")
    rows = rows.sort_values(["doc_id"])
    texts = [t if isinstance(t, str) else "" for t in rows["text"]]
    table, b0 = fit(restored(texts, lm), rows["toxic"].to_numpy(np.int64), prior, features)
    at = np.flatnonzero(table)
    model = (at, table[at], b0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, weights, intercept = model
        own = np.zeros(1 << BITS, np.float32)
        own[where] = weights
        used = own != 0
        for part in sliced(batches, "text", 500_000, 500):
            if part.num_rows:
                raw = string_list(part.column("text"))
                clean = restored(raw, lm)
                t, g = hits(clean, used)
                z = intercept + np.bincount(t, own[g], len(raw))
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                ids = part.column("doc_id").to_pylist()
                changed = [int(x != y) for x, y in zip(raw, clean, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([held_out(i) for i in ids]), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(changed, pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
