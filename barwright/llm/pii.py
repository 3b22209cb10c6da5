"""Personal data by a semi-Markov conditional random field beside fixed base patterns.

Base spans (email, ip, card, phone) are found by patterns, leftmost and non-overlapping within a kind. The field reads
stretches of tokens around digits and at-signs: a segment is one token outside of any entity, or up to ``MOST`` tokens
as an entity of a kind, scored by features of the whole span (its shape, digits, check sums, separators, neighbours).
A dynamic program over segment ends chooses boundaries and kinds jointly. What it finds beside the base spans (spelled
out addresses, telephone numbers without a plus, other groupings) is added where it beats "no entity" by ``MARGIN``.

There are no labelled rows for this: the field is trained on generated examples of each kind, and of numbers that are
none (dates, prices, keys, versions), set among words of a bounded sample of ``sample`` documents.

Spans are in code points, end exclusive. A null text is empty. Repeated rows are read each. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, sliced, string_list

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Tokens of the longest entity, tokens of context on each side, and the log odds that an added span needs.
MOST, AROUND, MARGIN = 22, 6, 2.0
TOKEN = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{1,4}(?=:)|(?<=:)[0-9a-fA-F]{1,4}(?![A-Za-z0-9])|[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-z0-9À-ɏ]")
TRIGGER = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|[0-9][\x20().:/_-]{0,3}(?:[0-9][\x20().:/_-]{0,3}){5,}|[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,}|\sat\s[a-z0-9.-]+\s+dot\s|[0-9]\s?[\[({<]\s?(?:dot|\.)|[0-9]\sdot\s[0-9]", re.I)

AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\sat\s.*\sdot\s", re.I)
DOTTED = re.compile(r"[0-9]{1,3}(?:\s?[\[({<]?\s?(?:dot|\.)\s?[\])}>]?\s?[0-9]{1,3}){1,3}", re.I)
HEXES = re.compile("[0-9a-fA-F:]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each base kind."""
    out: list[list[Span]] = [[], [], [], []]
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out[0].append((lo, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out[1].append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out[3].append(m.span())
    return out


def stretches(text: str) -> list[list[tuple[str, int, int]]]:
    """Tokens (text, start, end) around triggers; overlapping stretches are one."""
    areas: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = m.start(), m.end()
        for _ in range(AROUND):
            k = max(text.rfind(" ", 0, max(lo - 1, 0)), text.rfind("\n", 0, max(lo - 1, 0)))
            lo = max(k, lo - 40, 0)
        for _ in range(AROUND):
            ends = [k for k in (text.find(" ", hi + 1), text.find("\n", hi + 1)) if k >= 0]
            hi = min([*ends, hi + 40, len(text)])
        if areas and lo <= areas[-1][1]:
            areas[-1][1] = max(hi, areas[-1][1])
        else:
            areas.append([lo, hi])
    return [[(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)] for lo, hi in areas]


def segments(text: str, tokens: list[tuple[str, int, int]]) -> list[list[tuple[int, list[str]]]]:
    """For each token as a segment's end (exclusive, k + 1): possible starts with features of the whole span."""
    out: list[list[tuple[int, list[str]]]] = []
    n = len(tokens)
    for j in range(1, n + 1):
        found = []
        last = tokens[j - 1][0]
        if last.isalnum():
            for i in range(j - 1, max(-1, j - MOST - 1), -1):
                first, lo = tokens[i][0], tokens[i][1]
                if i < j - 1 and "\n" in text[tokens[i][2] : tokens[i + 1][1]]:
                    break
                if not (first.isalnum() or first in "+([{"):
                    continue
                span = text[lo : tokens[j - 1][2]]
                digits = sum(map(span.count, "0123456789"))
                if "@" in span or AT.search(span):
                    if not first.isalnum():
                        continue
                elif span.count(":") >= 3:
                    if not HEXES.fullmatch(span):
                        continue
                elif "dot" in span.lower() or "[" in span:
                    if not DOTTED.fullmatch(span):
                        continue
                elif digits < 7 or first in "[{" or not (first[0].isdigit() or first in "+(") or not last.isdigit():
                    continue
                before = tokens[i - 1] if i else ("^", lo - 1, lo - 1)
                after = tokens[j] if j < n else ("$", tokens[j - 1][2] + 1, 0)
                found.append((i, features(span, digits, before, lo, after, tokens[j - 1][2])))
        out.append(found)
    return out


def features(span: str, digits: int, before: tuple, lo: int, after: tuple, hi: int) -> list[str]:
    shape = re.sub(r"[a-zß-ɏ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[0-9]", "9", span)))
    short = re.sub(r"9+", "9", shape)
    letters = len(re.findall(r"[A-Za-z]", span))
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    out = [f"shape:{shape}" if len(shape) < 20 and not letters else "shape:-", f"short:{short}" if len(short) < 24 else "short:long", f"digits:{min(digits, 20)}", f"groups:{len(groups)}:{max(groups, default=0)}"]
    out += [f"glued:{int(before[2] == lo and before[0].isalnum())}{int(after[1] == hi and after[0].isalnum())}", f"near:{before[0].lower()[:8]}:{int(before[2] == lo)}", f"then:{after[0][:1] if not after[0].isalnum() else 'w'}:{int(after[1] == hi)}"]
    out += [f"letters:{min(letters, 3)}", f"first:{span[0] if not span[0].isalnum() else '9' if span[0].isdigit() else 'a'}"]
    spaced = re.fullmatch(r"\+?[0-9](?:([\x20._-])[0-9])(?:\1[0-9])+", span)
    out.append(f"apart:{int(spaced is not None)}:{min(digits, 20) if spaced else 0}")
    dotted = DOTTED.fullmatch(span)
    if dotted and letters:
        parts = re.findall("[0-9]+", span)
        out.append(f"dots:{len(parts)}:{int(all(int(p) < 256 for p in parts))}")
    if digits >= 12 and letters == 0:
        out.append(f"sum:{int(luhn(re.sub('[^0-9]', '', span)))}:{min(digits, 20)}")
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span):
        out.append(f"quad:{int(all(len(p) < 4 and int(p) < 256 for p in span.split('.')))}")
    if re.fullmatch(r"[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}", span):
        out.append(f"six:{min(span.count(':'), 7)}")
    m = re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(@|[\[({<]\s?at\s?[\])}>]|\bat\b)\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[A-Za-z0-9-]+)*", span, re.I)
    if m:
        out.append(f"rest:{int(re.match(r'[.][A-Za-z0-9]|[\[({<]?dot|[(\[]dot', after[0], re.I) is not None and after[1] - hi < 2)}")
        out.append(f"tail:{re.findall('[A-Za-z0-9]+', span)[-1].lower()[:6]}")
        out.append(f"mail:{'@' if m[1] == '@' else 'in' if m[1][0] in '[({<' else 'at'}:{int('dot' in span.lower() or '.' in span[span.find(m[1]) :])}")
    out.append(f"mail:{int(m is not None)}")
    return out


class Field:
    """Weights by feature and kind (0: no entity), of steps between kinds, and of a token outside."""

    def __init__(self, at: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.at, self.weights, self.steps = at, weights, steps

    def scores(self, fs: list[str]) -> np.ndarray:
        return self.weights[[self.at[f] for f in fs if f in self.at]].sum(axis=0)

    def decode(self, lattice: list[list[tuple[int, list[str]]]]) -> list[tuple[int, int, int, float]]:
        """(first token, end, kind, log odds against no entity) of the best segmentation."""
        n, k = len(lattice), len(KINDS) + 1
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back: list[list[tuple[int, int, float] | None]] = [[None] * k for _ in range(n + 1)]
        for j in range(1, n + 1):
            x = best[j - 1] + self.steps[:, 0]
            p = int(x.argmax())
            best[j, 0], back[j][0] = x[p], (j - 1, p, 0.0)
            for i, fs in lattice[j - 1]:
                s = self.scores(fs)
                x = best[i][:, None] + self.steps[:, 1:]
                for y in range(1, k):
                    p = int(x[:, y - 1].argmax())
                    if x[p, y - 1] + s[y - 1] > best[j, y]:
                        best[j, y], back[j][y] = x[p, y - 1] + s[y - 1], (i, p, float(s[y - 1] + self.steps[p, y] - (j - i) * self.steps[0, 0]))
        out = []
        j, y = n, int(best[n].argmax())
        while j:
            i, p, s = back[j][y]
            if y:
                out.append((i, j, y - 1, s))
            j, y = i, p
        return out[::-1]


def train(examples: list[tuple[list[list[tuple[int, list[str]]]], dict[tuple[int, int], int]]], rounds: int = 16, rate: float = 0.5, decay: float = 3e-4) -> Field:
    """Maximum likelihood: sums over all segmentations forward and backward, AdaGrad steps over single examples."""
    at: dict[str, int] = {}
    coded = []
    for lattice, gold in examples:
        rows = [[(i, np.array([at.setdefault(f, len(at)) for f in fs])) for i, fs in ends] for ends in lattice]
        coded.append((rows, gold))
    k = len(KINDS) + 1
    w, steps = np.zeros((len(at), k - 1)), np.zeros((k, k))
    gw, gs = np.full_like(w, 1e-2), np.full_like(steps, 1e-2)
    order = random.Random(5)
    lse = lambda x, axis: x.max(axis=axis) + np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis))
    for r in range(rounds):
        order.shuffle(coded)
        for rows, gold in coded:
            n = len(rows)
            alpha, beta = np.full((n + 1, k), -1e9), np.full((n + 1, k), -1e9)
            alpha[0, 0] = 0
            score = [[(i, w[c].sum(axis=0)) for i, c in ends] for ends in rows]
            for j in range(1, n + 1):
                alpha[j, 0] = lse(alpha[j - 1] + steps[:, 0], 0)
                for i, s in score[j - 1]:
                    alpha[j, 1:] = np.logaddexp(alpha[j, 1:], lse(alpha[i][:, None] + steps[:, 1:], 0) + s)
            beta[n] = 0
            z = lse(alpha[n], 0)
            ds = np.zeros_like(steps)
            dw: list[tuple[np.ndarray, np.ndarray]] = []
            for j in range(n, 0, -1):
                x = steps[:, 0] + beta[j, 0]
                beta[j - 1] = np.logaddexp(beta[j - 1], x)
                ds[:, 0] -= np.exp(alpha[j - 1] + x - z)
                for (i, s), (_, c) in zip(score[j - 1], rows[j - 1], strict=True):
                    x = steps[:, 1:] + s + beta[j, 1:]
                    beta[i] = np.logaddexp(beta[i], lse(x, 1))
                    p = np.exp(alpha[i][:, None] + x - z)
                    ds[:, 1:] -= p
                    g = -p.sum(axis=0)
                    if (i, j) in gold:
                        g[gold[i, j]] += 1
                    dw.append((c, g))
            ends = {j: (i, y + 1) for (i, j), y in gold.items()}
            j, seq = n, []
            while j:
                i, y = ends.get(j, (j - 1, 0))
                seq.append(y)
                j = i
            for a, b in zip([0, *seq[::-1]], seq[::-1], strict=False):
                ds[a, b] += 1
            ds -= decay * steps
            gs += ds * ds
            steps += rate * ds / np.sqrt(gs)
            for c, g in dw:
                gw[c] += g * g
                w[c] += rate * (g - decay * w[c]) / np.sqrt(gw[c])
        rate *= 0.9
    return Field(at, w, steps)


def made_examples(n: int, words: list[str], seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with entities (start, end, kind) and with numbers that are none."""
    rng = random.Random(seed)
    words = [w for w in words if w.isalpha()] or ["and", "the", "from", "with"]
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(words)
    low = lambda: re.sub("[^a-z]", "x", word().lower())[:8] or "ab"

    def card(k: int = 16) -> str:
        head = rng.choice("3456") + d(k - 2)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def entity() -> tuple[str, int]:
        kind = rng.randrange(4)
        if kind == 0:
            user = rng.choice([f"{low()}.{d(2)}", f"{low()}_{low()}", low(), f"{low()}{d(2)}"])
            host, end = rng.choice([low(), f"mail{d(1)}.{low()}"]), rng.choice(["com", "org", "net", "de", "example.com"])
            told = rng.choice([f"{user}@{host}.{end}", f"{user} [at] {host} [dot] {end}", f"{user} (at) {host}.{end}", f"{user}(at){host}(dot){end}", f"{user} at {host} dot {end}", f"{user} @ {host}.{end}", f"{user} at {host} dot {end}", f"{user}[at]{host}.{end}", f"{user} {{at}} {host} {{dot}} {end}"])
            return rng.choice([told, told, told.upper(), told.title(), told.replace("at", "AT").replace("dot", "DOT")]), 0
        if kind == 1:
            if rng.random() < 0.25:
                return ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), 1
            return rng.choice([".", ".", "[.]", " dot ", "(dot)"]).join(str(rng.randrange(256)) for _ in range(4)), 1
        if kind == 2:
            c = card(rng.choice([15, 16, 16, 16, 19]))
            sep, size = rng.choice([("", 4), (" ", 4), ("-", 4), (".", 4), ("_", 4), (" ", 1), ("-", 1), ("  ", 4)])
            return sep.join(c[k : k + size] for k in range(0, len(c), size)), 2
        a, b, c = d(3), d(3), d(4)
        if rng.random() < 0.25:
            return rng.choice([" ", "-", ".", " "]).join(rng.choice(["", "0"]) + a + b + c), 3
        return rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{rng.randrange(1, 99)}-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(7)}", f"00{rng.randrange(1, 99)} {a} {b}{c}"]), 3

    def none() -> str:
        year, m, day = rng.randrange(1900, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
        return rng.choice([
            f"{year}-{m:02d}-{day:02d}", f"{day:02d}/{m:02d}/{year}", f"{day:02d}.{m:02d}.{year}", f"{year}-{m:02d}-{day:02d} {d(2)}:{d(2)}:{d(2)}", d(rng.randrange(7, 15)), f"{d(3)},{d(3)},{d(3)}.{d(2)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))), "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)),
            f"v{d(1)}.{d(2)}.{d(3)}", f"{rng.randrange(256, 999)}.{rng.randrange(300, 999)}.{d(3)}.{d(3)}", f"{low()} at {low()} {d(8)}", f"{year}-{year + 9} {d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{d(2)} {d(3)} {d(2)} {d(4)}", f"{d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)}", ", ".join(d(1) for _ in range(9)), f"{d(1)}.{d(1)} dot {low()}", f"{d(4)}:{d(2)}:{d(2)}:{d(2)}", f"@{low()}", f"{low()} at {low()} dot {low()}", f"{low()} at {d(2)} dot {d(2)}", f"password={d(9)}a{d(8)}", f"{d(6)}-{d(6)}-{d(6)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(2, 8))) + rng.choice([" ", " ", ". ", ", ", "\n"])
            if rng.random() < 0.5:
                e, kind = entity()
                spans.append((len(text), len(text) + len(e), kind))
                text += e + rng.choice([" ", " ", ". ", "\n"])
            else:
                text += none() + " "
        out.append((text + word(), spans))
    return out


def lattices(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list, dict]]:
    """The stretches of an example with their gold segments; stretches that cut an entity are left out."""
    out = []
    for tokens in stretches(text):
        if not tokens:
            continue
        begin, end = {t[1]: k for k, t in enumerate(tokens)}, {t[2]: k + 1 for k, t in enumerate(tokens)}
        lattice = segments(text, tokens)
        gold = {}
        for lo, hi, kind in spans:
            if hi <= tokens[0][1] or lo >= tokens[-1][2]:
                continue
            key = (begin.get(lo, -1), end.get(hi, -1))
            if min(key) < 0 or key[0] not in {i for i, _ in lattice[key[1] - 1]}:
                break
            gold[key] = kind
        else:
            out.append((lattice, gold))
    return out


def field_from(texts: list[str], examples: int = 500) -> Field:
    words = [w for t in texts for w in t.split()]
    return train([x for text, spans in made_examples(examples, words) for x in lattices(text, spans)])


def added_spans(text: str, base: list[list[Span]], field: Field) -> list[tuple[int, int, int]]:
    """(kind, start, end) of entities that overlap no base span."""
    taken = sorted(s for spans in base for s in spans)
    out = []
    for tokens in stretches(text):
        lattice = segments(text, tokens)
        if not any(lattice):
            continue
        for i, j, kind, odds in field.decode(lattice):
            lo, hi = tokens[i][1], tokens[j - 1][2]
            if odds >= MARGIN and not any(a < hi and lo < b for a, b in taken):
                out.append((kind, lo, hi))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def found(docs: DataFrame, sample: int = 200, examples: int = 500) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, n_added and n_spans of each text. sample: documents whose words surround examples."""
    spark = docs.sparkSession
    ship(spark)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = docs.select(key.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    texts = [] if drawn is None else sorted(r["t"] for r in docs.where(key <= drawn).select(F.coalesce("text", F.lit("")).alias("t")).limit(sample).collect())
    f = field_from(texts, examples)
    model = (f.at, f.weights, f.steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model)
        for b in sliced(batches, "text"):
            rows: list[tuple] = []
            for text in string_list(b.column("text")):
                base = base_spans(text)
                more = added_spans(text, base, field) if TRIGGER.search(text) else []
                told = [f"{k}:{lo}:{hi}" for k, spans in zip(KINDS, base, strict=True) for lo, hi in spans]
                every = sorted([(n, lo, hi) for n, spans in enumerate(base) for lo, hi in spans] + more)
                rows.append((*map(len, base), hashlib.sha256(",".join(told).encode()).hexdigest(), ",".join(f"{KINDS[n]}:{lo}:{hi}" for n, lo, hi in every), len(more), len(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
