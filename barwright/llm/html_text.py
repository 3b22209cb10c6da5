"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text with no block element's border inside. A block's features are the tags of
its ancestors, parts of their class words, properties of its text: length, links, closing mark, how it stands to the blocks
around it (words of the neighbours, place on the page), and of its container: its share of the page's words, links and
closing marks, and how deep the block lies within the container that holds most text, or whether it lies outside. The
field has two labels, main text and the rest, is trained by maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages are a bounded sample of the table (``sample`` pages with the least hashes of their addresses), labelled
by the elements that HTML has for main text, and ``made`` generated pages of other layouts, labelled as they are
generated: main text in a ``div`` without a class, in sections, table cells or bare between tags, of long paragraphs or of
short lines, class words that say nothing, readers' comments under many names or none, after the article or within it,
forms, notices and adverts. Class words of the generated
pages are often made up, so that the field has to read structure and text.

Nulls and empty pages give the empty text. Repeated pages are read each. Unclosed and unmatched tags, a page cut off
in the middle of a tag, and an empty table are handled. Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, sliced, string_list

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b(?:[^>]*+)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|</?[a-zA-Z][^<>]*+\Z|([^<]++|<)",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

#: Elements and class words that say what a block is, for labelling pages.
MAIN, ASIDE = frozenset({"article", "main"}), frozenset("nav header footer aside form head button select textarea dialog menu".split())
Path = tuple[tuple[str, tuple[str, ...]], ...]
Block = tuple[Path, tuple[int, ...], str]


def _classes(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in CLASS.findall(attributes)).lower()
    return tuple(re.findall(r"[a-z]+", found))


def blocks(page: str) -> list[Block]:
    """(ancestors, text properties, text) of each leaf block with a text."""
    out: list[Block] = []
    path: Path = ()
    ids: tuple[int, ...] = ()  # a number for each open element
    places: list[tuple[int, ...]] = []
    parts: list[str] = []
    at: Path = ()
    at_ids: tuple[int, ...] = ()
    links = linked = made = 0

    spans: list[int] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((at, _properties(text, linked), text))
                places.append(at_ids)
                spans.append(linked)
        parts, linked = [], 0

    for m in TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            if not parts:
                at, at_ids = path, ids
            parts.append(text)
            if links:
                linked += len(text)
            continue
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append("\n") if parts else None
            continue
        block = name in BLOCKS
        if block:
            flush()
        if not m[2]:
            if block and name not in ("body", "html") and any(p[0] == "p" for p in path):
                k = next(i for i, p in enumerate(path) if p[0] == "p")
                path, ids = path[:k], ids[:k]
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and path and path[-1][0] == name:
                path, ids = path[:-1], ids[:-1]
            # a slash before the end closes nothing in HTML but elements that are void anyway, and SVG's, which are skipped
            if name not in VOID:
                made += 1
                path, ids = (*path, (name, _classes(m[4]))), (*ids, made)
        else:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == name:
                    path, ids = path[:k], ids[:k]
                    break
        if name == "a":
            links = sum(p[0] == "a" for p in path)
        elif block:
            links = links and sum(p[0] == "a" for p in path)
    flush()
    return placed(out, places, spans)


def _properties(text: str, linked: int) -> tuple[int, ...]:
    words = text.count(" ") + 1
    return (min(words.bit_length(), 6), 0 if not linked else 1 if 2 * linked < len(text) else 2, int(text[-1] in ".!?\"'”»"), int(text[0] in "©®" or "©" in text[:40]))


def placed(found: list[Block], places: list[tuple[int, ...]], linked: list[int]) -> list[Block]:
    """Blocks with more properties: the neighbours' words, whether all before were short, quarter of the page; depth below the heaviest container, inside or outside of the page's main elements, and the container's words, links and closing marks."""
    n, most, out = len(found), 0, []
    # a block weighs for the element that its own lies in, and half as much for the next one
    weight: dict[int, float] = {}
    boxes: dict[int, list[int]] = {}  # words, characters, linked characters, blocks, closing marks
    total = 0
    for (_, p, text), ids, span in zip(found, places, linked, strict=True):
        words = text.count(" ") + 1
        total += words
        box = boxes.setdefault(ids[-2] if len(ids) > 1 else 0, [0, 0, 0, 0, 0])
        for k, v in enumerate((words, len(text), span, 1, p[2])):
            box[k] += v
        if p[1] < 2:
            for share, i in zip((1.0, 0.5), reversed(ids[:-1]), strict=False):
                weight[i] = weight.get(i, 0.0) + share * words
    heavy = max(weight, key=lambda i: (weight[i], -i), default=0)
    begins = next((k for k, ids in enumerate(places) if heavy in ids), n)
    # the innermost main element that a block lies in; main elements after the first are told apart
    mains = [next((i for (e, _), i in zip(reversed(path), reversed(ids), strict=True) if e in MAIN), 0) if not any(e[0] in ASIDE for e in path) else 0 for (path, _, _), ids in zip(found, places, strict=True)]
    first_main = next((i for i in mains if i), 0)
    third = lambda x, of: 0 if 8 * x < of else 1 if 2 * x < of else 2
    for k, ((path, p, text), ids) in enumerate(zip(found, places, strict=True)):
        before, after = (found[k - 1][1][0] if k else 0), (found[k + 1][1][0] if k + 1 < n else 0)
        depth = min(len(ids) - 1 - ids.index(heavy), 4) if heavy in ids else 5 + (k > begins)
        words, chars, span, count, marks = boxes[ids[-2] if len(ids) > 1 else 0]
        box = (third(words, total), third(span, chars), third(marks, count), min(count.bit_length(), 4))
        out.append((path, (*p, int(before >= 4), int(after >= 4), int(most >= 4), 4 * k // n, depth, 0 if not first_main else 2 if not mains[k] else 1 if mains[k] == first_main else 3, *box), text))
        most = max(most, p[0])
    return out


def features(path: Path, props: tuple[int, ...]) -> list[str]:
    names = [p[0] for p in path if p[0] in BLOCKS]
    classes = {c for p in path for c in p[1]}
    # a class word and its first letters, so that disqus-thread, commentlist and adslot are known by their beginnings
    out = {f"in:{n}" for n in names} | {f"class:{c}" for c in classes} | {f"begins:{c[:4]}" for c in classes if len(c) > 4}
    own = names[-1] if names else "-"
    out |= {f"own:{own}", f"words:{props[0]}", f"links:{props[1]}", f"mark:{props[2]}", f"sign:{props[3]}", f"text:{props[0]}:{props[1]}:{props[2]}", f"own:{own}:{props[0]}:{props[1]}", "any"}
    out |= {f"around:{props[4]}{props[5]}", f"begun:{props[6]}", f"quarter:{props[7]}", f"begun:{props[6]}:{props[0]}:{props[1]}"}
    depth, main, share, links, marks, count = props[8:]
    # words of one kind teach alike, also those that few pages use
    out |= {f"told:{kind}" for kind, words in (("aside", ASIDE_CLASSES), ("comments", COMMENTS), ("main", MAIN_CLASSES)) if classes & words}
    out |= {f"depth:{depth}", f"main:{main}", f"depth:{depth}:{main}", f"box:{share}{links}{marks}", f"box:{share}{links}:{depth}", f"blocks:{count}{links}", f"depth:{depth}:{props[0]}:{props[1]}", f"own:{own}:{depth}", f"main:{main}:{own}", f"main:{main}:{props[0]}:{props[1]}", f"box:{share}{links}:{main}:{depth}"}
    return sorted(out)


class Field:
    """A linear chain over two labels; weights of features by label, of steps, and of the first label."""

    def __init__(self, names: list[str], weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.at = {n: k for k, n in enumerate(names)}
        self.weights, self.steps, self.first = weights, steps, first
        self.memo: dict[tuple, tuple[float, float]] = {}

    def score(self, path: Path, props: tuple[int, ...]) -> tuple[float, float]:
        key = (path, props)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            at = [self.at[f] for f in features(path, props) if f in self.at]
            s = self.weights[at].sum(axis=0)
            got = self.memo[key] = (float(s[0]), float(s[1]))
        return got

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        if not page:
            return []
        t00, t01, t10, t11 = self.steps.reshape(-1).tolist()
        a, b = (x + y for x, y in zip(self.first.tolist(), self.score(page[0][0], page[0][1]), strict=True))
        back = []
        for path, props, _ in page[1:]:
            e0, e1 = self.score(path, props)
            f0, f1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((f0, f1))
            a, b = (b + t10 if f0 else a + t00) + e0, (b + t11 if f1 else a + t01) + e1
        y = int(b > a)
        labels = [y]
        for f in reversed(back):
            y = int(f[y])
            labels.append(y)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 250, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """Maximum likelihood with an L2 penalty: forward-backward over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for bs, _ in pages for path, props, _ in bs for f in features(path, props)})
    at = {n: k for k, n in enumerate(names)}
    n, most = len(pages), max((len(b) for b, _ in pages), default=1)
    rows, cols, seq, pos = [], [], [], []
    gold, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    k = 0
    for i, (bs, ys) in enumerate(pages):
        for j, (path, props, _) in enumerate(bs):
            fs = [at[f] for f in features(path, props)]
            rows += [k] * len(fs)
            cols += fs
            seq.append(i)
            pos.append(j)
            gold[i, j], mask[i, j] = ys[j], True
            k += 1
    rows, cols, seq, pos = (np.array(x, np.int64) for x in (rows, cols, seq, pos))
    size = len(names) * 2 + 6
    w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for r in range(1, rounds + 1):
        weights, steps, first = w[:-6].reshape(-1, 2), w[-6:-2].reshape(2, 2), w[-2:]
        e = np.zeros((n, most, 2))
        flat = np.stack([np.bincount(rows, weights[cols, y], k) for y in (0, 1)], axis=1)
        e[seq, pos] = flat
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, most):
            new = log_sum(alpha[:, t - 1, :, None] + steps, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = log_sum(alpha[:, -1], 1)
        pair = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            x = steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], log_sum(x, 2), 0)
            p = np.exp(alpha[:, t, :, None] + x - z[:, None, None]) * mask[:, t + 1, None, None]
            pair += p.sum(axis=0)
        prob = np.exp(alpha + beta - z[:, None, None])
        truth = np.eye(2)[gold]
        diff = (truth - prob)[seq, pos]
        g = np.zeros_like(w)
        g[:-6] = np.stack([np.bincount(cols, diff[rows, y], len(names)) for y in (0, 1)], axis=1).reshape(-1)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        g[-6:-2], g[-2:] = (seen - pair).reshape(-1), (truth[:, 0] - prob[:, 0]).sum(axis=0)
        g = g / n - decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Field(names, w[:-6].reshape(-1, 2), w[-6:-2].reshape(2, 2), w[-2:])


#: Class words of generated pages.
COMMENTS = frozenset("comments comment disqus replies reader-replies responses discussion talkback feedback-list guestbook commentlist respond opinions".split())
ASIDE_CLASSES = frozenset("ad ads advert banner sidebar cookie notice comments comment share related promo newsletter menu breadcrumb subscribe widget footer popup login".split())
MAIN_CLASSES = frozenset("content post entry story body text".split())


def labelled(page: list[Block]) -> list[int]:
    """1 for blocks inside main elements and outside of the others."""
    out = []
    for path, _, _ in page:
        names, words = {p[0] for p in path}, {c for p in path for c in p[1]}
        out.append(int(bool(names & MAIN) and not names & ASIDE and not words & ASIDE_CLASSES))
    return out


def made_pages(n: int, texts: list[str], seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages of random layouts around the given texts, with their labels."""
    rng = random.Random(seed)
    texts = [t for t in texts if t.strip()] or ["A line of text.", "Another one, somewhat longer than the first."]
    out = []
    for _ in range(n):
        marks: list[tuple[str, int]] = []
        kind = rng.choice(["article", "main", "article", "class", "both", "div", "div", "section", "section", "cell", "bare", "id"])
        tagged = kind in ("article", "main", "both")
        some = lambda most=(30, 80, 400): html.escape(rng.choice(texts)[: rng.choice(most)])

        def para(label: int, tag: str = "p") -> str:
            marks.append((tag, label))
            # what stands around the main text is mostly shorter
            inner = some() if label or rng.random() < 0.1 else some((15, 30, 60, 120))
            if rng.random() < 0.2:
                inner = f"<b>{inner}</b><br>"
            if rng.random() < 0.15:
                inner = f'{inner} <a href="#">{some()[:20]}</a> {some()[:60]}'
            return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "") if tag == "p" else f"<{tag}>{inner}</{tag}>"

        def name(known: frozenset[str]) -> str:
            """A class or id: a telling word, a made-up one, or none."""
            kind = rng.random()
            word = rng.choice(sorted(known)) if kind < 0.5 else "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
            return "" if kind > 0.75 else f' {rng.choice(["class", "class", "id"])}="{word}{rng.choice(["", "-box", "_1", "-area"])}"'

        def short(label: int, tag: str, link: bool) -> str:
            marks.append((tag, label))
            inner = html.escape(" ".join(rng.choice(texts).split()[: rng.randint(1, 5)]) or "x")
            return f"<{tag}>" + (f'<a href="/{len(marks)}">{inner}</a>' if link else inner) + f"</{tag}>"

        def comments() -> str:
            out = short(0, rng.choice(["h2", "h3", "p"]), False) if rng.random() < 0.6 else ""
            for _ in range(rng.randint(1, 5)):
                body = short(0, rng.choice(["div", "h4", "p"]), rng.random() < 0.5) if rng.random() < 0.6 else ""
                body += para(0, rng.choice(["p", "p", "div"]))
                # comments are articles only where the article is one as well
                out += rng.choice([f"<li>{body}</li>", f"<div{name(COMMENTS)}>{body}</div>", body, f"<article{name(COMMENTS)}>{body}</article>" if tagged else body])
            return f"<{(t := rng.choice(['section', 'div', 'div', 'ol', 'ul']))}{name(COMMENTS)}>{out}</{t}>"

        def notice() -> str:
            return f"<{(t := rng.choice(['div', 'div', 'section', 'aside']))}{name(ASIDE_CLASSES)}>" + "".join(rng.choice([para, para, lambda y: short(y, "button", False)])(0) for _ in range(rng.randint(1, 2))) + f"</{t}>"

        def lines() -> str:
            """Main text of short lines: verse, lists, recipes."""
            tag, made = rng.choice(["p", "p", "div", "li", "td", "dd"]), ""
            for _ in range(rng.randint(2, 14)):
                marks.append((tag, 1))
                made += f"<{tag}>" + html.escape(" ".join(rng.choice(texts).split()[: rng.randint(1, 7)]) or "x") + rng.choice(["", "", ",", "."]) + f"</{tag}>"
            return made if tag in ("p", "div") or rng.random() < 0.4 else f"<ul>{made}</ul>"

        def rest() -> str:
            kind = rng.choice(["nav", "header", "footer", "aside", "form", "class", "class", "links", "links", "table", "rights"])
            if kind == "rights":
                marks.append(("rights", 0))
                return f"<{(t := rng.choice(['div', 'p', 'footer']))}{name(ASIDE_CLASSES)}>&copy; {rng.randrange(1990, 2030)} {html.escape(rng.choice(texts).split()[0])}</{t}>"
            if kind == "links":
                inner = "".join(short(0, rng.choice(["li", "div", "p", "td"]), True) for _ in range(rng.randint(2, 8)))
                return f"<div{name(ASIDE_CLASSES)}><ul>{inner}</ul></div>"
            if kind == "table":
                return "<table><tr>" + "".join(short(0, "td", rng.random() < 0.8) for _ in range(rng.randint(2, 6))) + "</tr></table>"
            inner = "".join(para(0, rng.choice(["p", "li", "div", "h3", "span"])) for _ in range(rng.randint(1, 5)))
            return f'<div class="{rng.choice(sorted(ASIDE_CLASSES))}">{inner}</div>' if kind == "class" else f"<{kind}>{inner}</{kind}>"

        def article() -> str:
            inner = (para(1, "h1") if rng.random() < 0.5 else short(1, rng.choice(["h1", "h2"]), False)) if rng.random() < 0.8 else ""
            verse = rng.random() < 0.25
            if verse:
                inner += lines()
            for _ in range(rng.randint(1, 12) if not verse or rng.random() < 0.3 else 0):
                inner += para(1, rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre", "td"]))
                if rng.random() < 0.12:
                    inner += rest() if rng.random() < 0.6 else notice()
                if rng.random() < 0.06:
                    inner += "<table>" + "".join("<tr>" + "".join(short(1, "td", False) for _ in range(rng.randint(2, 4))) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            if rng.random() < 0.12:
                inner += comments()
            if kind == "section":
                return f"<section{name(MAIN_CLASSES) if rng.random() < 0.3 else ''}>{inner}</section>"
            if kind == "bare":
                marks.append(("bare", 1))
                inner += html.escape(" ".join(rng.choice(texts) for _ in range(3)))
                return f'<{(t := rng.choice(["main", "div", "article"]))}>{inner}</{t}>'
            if kind == "cell":
                return f"<table><tr><td>{inner}</td></tr></table>"
            if kind in ("class", "div", "id"):
                return f"<div{name(MAIN_CLASSES) if kind != 'div' else ''}>{inner}</div>"
            return f'<main><div class="{rng.choice(sorted(MAIN_CLASSES))}">{inner}</div></main>' if kind == "both" else f"<{kind}>{inner}</{kind}>"

        page = "<html><head><title>" + some() + "</title></head><body>"
        marks.append(("title", 0))
        page += "".join(rest() for _ in range(rng.randint(0, 3))) + (notice() if rng.random() < 0.6 else "") + article() + (comments() if rng.random() < 0.5 else "") + "".join(rest() for _ in range(rng.randint(0, 3))) + "</body></html>"
        found = blocks(page)
        labels = _by_marks(found, marks)
        if labels is not None:
            out.append((found, labels))
    return out


def _by_marks(found: list[Block], marks: list[tuple[str, int]]) -> list[int] | None:
    """Labels in order of generation; inline spans may join, then the page isn't used."""
    return [y for _, y in marks] if len(found) == len(marks) else None


def field_from(pages: list[str], made: int) -> Field:
    real = [blocks(p) for p in pages]
    texts = [t for bs in real for _, _, t in bs if len(t) > 20]
    return train([(bs, labelled(bs)) for bs in real] + made_pages(made, texts))


def extracted(pages: DataFrame, sample: int = 150, made: int = 1500) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each page."""
    spark = pages.sparkSession
    ship(spark)
    order = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    drawn = pages.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    known = [] if drawn is None else [r["html"] or "" for r in pages.where(order <= F.lit(drawn)).select("html").limit(sample).collect()]
    field = field_from(known, made)
    model = (list(field.at), field.weights, field.steps, field.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*model)
        for b in sliced(batches, "html", 500_000):
            texts, counts = [], []
            for page in string_list(b.column("html")):
                found = blocks(page)
                texts.append("\n\n".join(x[2] for x, y in zip(found, own.decode(found), strict=True) if y))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
