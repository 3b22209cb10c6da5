"""Phrase collocations: a sketch bounds all phrases, Aho-Corasick automata count those that may be frequent.

Texts in lower case (A-Z) are cut at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words. For each
lang, f(phrase) counts all contiguous occurrences within pieces, overlaps included, and n all words. Candidates are phrases
of 2 to ``longest`` words with a = f(phrase) >= ``least``. Cutting one gives l and r, the counts of its two parts, and
floor(2000000 a / (l + r)); the cut with the lowest score counts, ties going to the shortest first part. A candidate inside
a longer one that has at least ``share`` percent of its count is dropped.

1. A count-min sketch of words and pairs, then one of the runs of three and four words whose pairs may all be frequent.
   Tasks emit sums of cells, cut off at ``least`` (which loses nothing of the question whether a sum reaches it); a shuffle
   adds them, and one bit a cell remains: is the bound at least ``least``? Its size is fixed before, by the bytes of all
   texts up to 2^``most_bits`` cells, and that is what is broadcast. Too small a sketch lets more phrases pass, never fewer.
2. A task takes its texts in shards of about ``shard`` bytes. The phrases in a shard that the sketches admit become one
   automaton for each lang. Words are guarded by delimiters (`` a b ``), so that a match covers whole words; pieces are
   divided by a line feed, which no phrase holds. The automaton's overlapping matches are counted.
3. Counts go sorted and compressed to buckets of phrases, which sum them over shards; thresholds, scores and ranks are
   taken of exact sums. Scores are decimals.

Nulls: a null text is empty, a null lang is ``und``. Empty texts and tables give nothing. Repeated rows count again. Texts
of any length are hashed in overlapping chunks, which can only raise a bound. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import ship, shuffle_partitions, sliced, small, splitmix, staged, string_list

LEAST, LONGEST, SHARE, TOP, UNKNOWN = 30, 4, 80, 2000, "und"
MOST_BITS, SHARD, CHUNK = 28, 16_000_000, 1_000_000
#: Cells and phrases that a task holds before it emits their sums.
CELLS, PHRASES = 16_000_000, 500_000
_BLOCK = 16  # bits of a cell's place within a block
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _SEPARATORS, bytes(range(97, 123)) + b" " + b"\n" * len(_SEPARATORS))
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.full(1024, _BASE, np.uint64))


def normalized(text: str) -> bytes:
    """Pieces between line feeds, their words divided and surrounded by single blanks."""
    return re.sub(b" +", b" ", (b" " + text.encode().translate(_LOWER).replace(b"\n", b" \n ") + b" "))


def chunks(text: bytes, size: int = CHUNK, words: int = LONGEST) -> Iterator[bytes]:
    """Parts of about so many bytes, cut between words; each repeats the last words before it."""
    lo = 0
    while len(text) - lo > size:
        cut, back = lo + size - 1, lo
        while cut >= 0 and back <= lo:  # until there are words enough to repeat
            cut = back = text.find(b" ", cut + 1)
            for _ in range(2 * words):  # a line feed between blanks counts as one
                back = max(text.rfind(b" ", lo, back), lo) if cut >= 0 else back
        if cut < 0:
            break
        yield text[lo : cut + 1]
        lo = back
    yield text[lo:]


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: bytes times odd powers by their place in the word, added up."""
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = buf[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(own * _POWERS[place % 1024] + place.astype(np.uint64)))])
    at = np.cumsum(sizes)
    total = sums[at] - sums[at - sizes]
    return splitmix(total)


def grams(text: bytes, lang: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words' starts and ends, and for each length the hashes of runs that begin at each word and whether they lie in one piece."""
    buf = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], (buf != 32) & (buf != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, [(np.zeros(0, np.uint64), np.zeros(0, bool))] * LONGEST
    piece = np.cumsum(buf == 10)[starts]
    word = _word_hashes(buf, starts, ends)
    run, out = splitmix(word ^ np.uint64(lang)), []
    out.append((run, np.ones(len(run), bool)))
    for k in range(2, LONGEST + 1):
        n = max(len(word) - k + 1, 0)
        run = splitmix(run[:n] * np.uint64(_BASE) + word[k - 1 :][:n])
        out.append((run, piece[:n] == piece[k - 1 :][:n]))
    return starts, ends, out


def lang_seed(lang: str) -> int:
    return int(_word_hashes(np.frombuffer(lang.encode(), np.uint8), np.array([0]), np.array([len(lang.encode())]))[0]) if lang else 1


class Sketch:
    """Bits of the cells whose sums reach the threshold; two rows of 2^bits cells."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def places(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return (g & mask).astype(np.uint32), ((g >> np.uint64(64 - self.bits)) + np.uint64(1 << self.bits)).astype(np.uint32)

    def admits(self, g: np.ndarray) -> np.ndarray:
        ok = np.ones(len(g), bool)
        for p in self.places(g):
            ok &= (self.cells[p >> np.uint32(3)] >> (p & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return ok


def admitted(runs: list[tuple[np.ndarray, np.ndarray]], low: Sketch, high: Sketch | None) -> list[np.ndarray]:
    """For each length, which runs may be frequent: their bounds and those of all runs within them reach the threshold."""
    out = [low.admits(runs[0][0])]
    for k, (g, whole) in enumerate(runs[1:], 1):
        before = out[-1]
        ok = whole & before[: len(g)] & before[1 : len(g) + 1]
        at = np.flatnonzero(ok)
        if k == 1:
            ok[at] = low.admits(g[at])
        elif high is not None:
            ok[at] = high.admits(g[at])
        out.append(ok)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in sliced(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), string_list(b.column("text")), strict=True):
            if text:
                yield lang, normalized(text)


def _bundled(texts: Iterator[tuple[str, bytes]], size: int) -> Iterator[tuple[str, bytes]]:
    """Texts of one lang joined to about so many bytes (a longer one stands alone), all langs together within the same bound."""
    held, total = defaultdict(list), 0
    for lang, text in texts:
        if held and total + len(text) > size:
            yield from ((k, b"\n".join(v)) for k, v in held.items())
            held, total = defaultdict(list), 0
        held[lang].append(text)
        total += len(text)
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def packed(places: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places of a block (16 bits) as steps, low bytes before high ones (nearly all 0), then sums of 8 bits: it compresses well."""
    steps = np.diff(places, prepend=np.uint16(0)).astype("<u2").view(np.uint8).reshape(-1, 2)
    return steps.T.tobytes() + n.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(parts[0] + (parts[1] << 8)), parts[2]


def _cells(batches: Iterator[pa.RecordBatch], bits: int, least: int, low: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Sums of cells by block, cut off at the threshold."""
    sketch, first = Sketch(bits, np.zeros(0, np.uint8)), low and Sketch(*low)
    held, total = [], 0

    def emitted() -> pa.RecordBatch:
        cells = np.concatenate(held)
        held.clear()
        cells.sort()
        new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        n = np.minimum(np.diff(new, append=len(cells)), least).astype(np.uint8)
        places = cells[new]
        blocks, cut = np.unique(places >> np.uint32(_BLOCK), return_index=True)
        low16 = (places & np.uint32((1 << _BLOCK) - 1)).astype(np.uint16)
        ends = [*cut[1:].tolist(), len(places)]
        return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([packed(low16[a:b], n[a:b]) for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary())], names=["block", "sums"])

    for lang, text in _bundled(_texts(batches), CHUNK):
        seed = lang_seed(lang)
        for part in chunks(text):
            _, _, runs = grams(part, seed)
            if first is None:
                own = [g[whole] for g, whole in runs[:2]]
            else:
                pair = admitted(runs[:2], first, None)[1]
                own, ok = [], pair
                for g, whole in runs[2:]:
                    ok = ok[: len(g)] & pair[len(pair) - len(g) :] if len(g) else ok[:0]
                    own.append(g[whole & ok])
            for g in own:
                held += sketch.places(g)
                total += 2 * len(g)
            if total >= CELLS:
                yield emitted()
                total = 0
    if total:
        yield emitted()


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row of bits for each block, from rows in order of block."""
    now, sums = None, np.zeros(1 << _BLOCK, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
            if block != now:
                if now is not None and (sums >= least).any():
                    yield row()
                now = block
                sums[:] = 0
            at, n = unpacked(data)
            sums[at] += n
    if now is not None and (sums >= least).any():
        yield row()


def sketched(docs: DataFrame, bits: int, least: int, low: tuple[int, np.ndarray] | None = None) -> tuple[int, np.ndarray]:
    """(bits, cells) of the sketch of words and pairs; with that one as low, of longer runs. The driver gets 2^bits / 4 bytes at most."""
    shared = low and docs.sparkSession.sparkContext.broadcast(low)
    sums = docs.mapInArrow(lambda it: _cells(it, bits, least, shared and shared.value), "block int, sums binary")
    added = sums.repartition(shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(lambda it: _summed(it, least), "block int, bits binary")
    cells = np.zeros(2 << bits >> 3, np.uint8)
    for r in added.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        at = r["block"] << _BLOCK >> 3
        cells[at : at + len(part)] = part[: len(cells) - at]
    return bits, cells


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate(phrases):
        a.add_word(f" {p} ", k)
    a.make_automaton()
    return a


def counted(text: bytes, lang: str, low: Sketch, high: Sketch) -> tuple[int, dict[str, int]]:
    """How many words the text has, and how often it has each phrase that the sketches admit."""
    seed, found = lang_seed(lang), {}
    for part in chunks(text):
        starts, ends, runs = grams(part, seed)
        for k, ok in enumerate(admitted(runs, low, high)):
            at = np.flatnonzero(ok)
            names, first = np.unique(runs[k][0][at], return_index=True)
            for name, i in zip(names.tolist(), at[first].tolist(), strict=True):
                if name not in found:
                    found[name] = part[starts[i] : ends[i + k]]
    if not found:
        return _n_words(text), {}
    phrases = sorted({p.decode() for p in found.values()})
    hits = Counter(map(itemgetter(1), automaton(phrases).iter(text.decode())))
    return _n_words(text), {phrases[k]: n for k, n in hits.items()}


def _n_words(text: bytes) -> int:
    buf = np.frombuffer(text, np.uint8)
    inside = (buf != 32) & (buf != 10)
    return int((inside[1:] & ~inside[:-1]).sum() + inside[:1].sum())


def _scanned(batches: Iterator[pa.RecordBatch], low: Sketch, high: Sketch, buckets: int) -> Iterator[pa.RecordBatch]:
    """lang, bucket and counts of a task's shards, summed as far as its memory goes. The phrases of a bucket go sorted and compressed; the empty phrase has the number of words."""
    sums: dict[str, Counter] = defaultdict(Counter)
    pack = zstandard.ZstdCompressor(level=3).compress

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, found in sums.items():
            dealt = defaultdict(list)
            for p in found:
                dealt[zlib.crc32(p.encode()) % buckets].append(p)
            data = []
            for own in dealt.values():
                own.sort()
                counts = np.array([found[p] for p in own], "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
                data.append(pack(len(own).to_bytes(8, "little") + counts + "\n".join(own).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(data), pa.string()), pa.array(list(dealt), pa.int32()), pa.array(data, pa.binary())], names=["lang", "bucket", "counts"])
        sums.clear()

    for lang, text in _bundled(_texts(batches), SHARD):
        n, found = counted(text, lang, low, high)
        sums[lang][""] += n
        sums[lang].update(found)
        if sum(map(len, sums.values())) >= PHRASES:
            yield from emitted()
    yield from emitted()


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words, f of the phrases that reach the threshold, from rows in order of lang and bucket."""
    now, sums = None, Counter()
    unpack = zstandard.ZstdDecompressor().decompress

    def rows() -> pa.RecordBatch:
        own = {p: f for p, f in sums.items() if f >= least or not p}
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p in own], pa.int32()), pa.array(list(own.values()), pa.int64())], names=["lang", "phrase", "words", "f"])

    for b in batches:
        for lang, bucket, data in zip(*(b.column(c).to_pylist() for c in ("lang", "bucket", "counts")), strict=True):
            if (lang, bucket) != now:
                if now is not None:
                    yield rows()
                now, sums = (lang, bucket), Counter()
            raw = unpack(data)
            size = int.from_bytes(raw[:8], "little")
            n = np.frombuffer(raw, np.uint8, 8 * size, 8).reshape(8, -1).T.copy().view("<u8").ravel()
            for p, f in zip(raw[8 + 8 * size :].decode().split("\n"), n.tolist(), strict=True):
                sums[p] += f
    if now is not None:
        yield rows()


def counts(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, phrase, words, f: exact counts of all phrases of 1 to LONGEST words that occur least times or more; the empty phrase counts words."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    bits = min(max(int(size // 8).bit_length(), _BLOCK), most_bits)
    low = sketched(read, bits, least)
    high = sketched(read, bits, least, low)
    both = spark.sparkContext.broadcast((low, high))
    buckets = max(64, size // 50_000_000)
    scanned = read.mapInArrow(lambda it: _scanned(it, Sketch(*both.value[0]), Sketch(*both.value[1]), buckets), "lang string, bucket int, counts binary")
    dealt = scanned.repartition(shuffle_partitions(spark), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return staged(dealt.mapInArrow(lambda it: _merged(it, least), "lang string, phrase string, words int, f long"), "phrases")


def _runs(phrase: str, sizes: str) -> str:
    """SQL: all runs of phrase's words whose numbers of words are given by a sequence."""
    return f"flatten(transform({sizes}, k -> transform(sequence(0, size(split({phrase}, ' ')) - k), i -> array_join(slice(split({phrase}, ' '), i + 1, k), ' '))))"


def mined(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first collocations by score and a descending, phrase ascending."""
    found = counts(docs, least, most_bits)
    of = found.where("words > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("f").alias("of_f"))
    cand = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # each part of each cut meets its count; parts are at least as frequent as the phrase, so that none is missing
    words = F.split("phrase", " ")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.array_join(w, " ").alias("part")) for s, w in ((0, F.slice(words, 1, F.col("cut"))), (1, F.slice(words, F.col("cut") + 1, F.col("words") - F.col("cut"))))])).alias("p"))
    met = parts.select("lang", "phrase", "a", "cut", "p.side", "p.part").join(of, (F.col("lang") == F.col("of_lang")) & (F.col("part") == F.col("of")))
    sides = met.groupBy("lang", "phrase", "cut").agg(F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("of_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("of_f"))).alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = sides.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = cand.where("words > 2").select("lang", F.explode(F.array_distinct(F.expr(_runs("phrase", "sequence(2, words - 1)")))).alias("phrase"), "a").groupBy(F.col("lang").alias("in_lang"), F.col("phrase").alias("in_phrase")).agg(F.max("a").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    own = scored.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    own = own.where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * share)).drop("in_lang", "in_phrase", "longer")
    # the first of each part of a lang, then of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = shuffle_partitions(docs.sparkSession)
    parted = own.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(n))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("words = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    return ranked.join(small(totals), F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(docs: str = "documents", least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB's SQL for mined(): every phrase is counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {docs}),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k FROM places, range(1, {LONGEST + 1}) r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT DISTINCT lang, phrase AS whole, k, a, w, unnest(range(2, k)) AS m FROM cuts), range(1, {LONGEST + 1}) s(i) WHERE i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON b.lang = g.lang AND b.phrase = g.phrase WHERE g.longer IS NULL OR CAST(g.longer AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * {share}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON k.lang = t.lang WHERE k.rank <= {top}
"""
