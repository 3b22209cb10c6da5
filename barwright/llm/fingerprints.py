"""Document fingerprints by invertible Bloom lookup tables.

A text's paragraphs are its lines; each, with its number among equal ones, has a 64-bit digest and a length in code points.
Digests are added to the cells of a table: three sub-tables, whose cells keep a count and the XOR of digests, of lengths
and of check sums. The table is the text's fingerprint. A sub-table has a power of two of cells, half as many as the text
has paragraphs at least; a paragraph's cell is given by low bits, so that a table folds to half its cells by adding halves.

Two fingerprints are folded to the smaller one's size and subtracted cell by cell; peeling the cells that hold a single
digest recovers the digests, and so the lengths, of the paragraphs in which the texts differ. Where peeling stalls, both
tables are built anew with twice the cells of the larger, again and again until it ends. Likeness is 1 - (length of what
differs) / (length of both).

Nulls: a null text is empty; two texts without paragraphs are alike (1.0). Rows that repeat an id come in order of their
texts. A null id comes last. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import bucket_of, id_order, range_bounds, ship, shuffle_partitions, sliced, splitmix, string_list

#: Least cells of a sub-table, and how many times a paragraph's cells a table may have before digests are held against each other.
CELLS, LARGEST = 2, 4096
_CHECK, _STEP, _LOW = np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)
_STEPS = [np.uint64(0x9E3779B97F4A7C15 * t % 2**64) for t in (1, 2, 3)]

#: Digests and lengths of a text's paragraphs.
Keys = tuple[np.ndarray, np.ndarray]
#: Counts and the XORs of digests, lengths and check sums, by cell.
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def digests(text: str) -> Keys:
    """Equal paragraphs are told apart by their number."""
    keys, sizes, seen = [], [], {}
    for p in paragraphs(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        keys.append(xxhash.xxh64_intdigest(p, k))
        sizes.append(len(p))
    return np.array(keys, np.uint64), np.array(sizes, np.uint64)


def _sums(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """32-bit check sums of digests and lengths."""
    return splitmix(keys ^ splitmix(sizes + _STEP) ^ _CHECK) & _LOW


def _cell(keys: np.ndarray, t: int, cells: int) -> np.ndarray:
    return t * cells + (splitmix(keys + _STEPS[t]) & np.uint64(cells - 1)).astype(np.int64)


def sketches(owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, n: int, cells: int, sign: np.ndarray | int = 1) -> Table:
    """Tables (n, 3 * cells) of n texts. owner: the text of each key; cells: a power of two; sign: 1 adds a key, -1 subtracts it."""
    count, *xors = np.zeros((n, 3 * cells), np.int64), *(np.zeros((n, 3 * cells), np.uint64) for _ in range(3))
    values = (keys, sizes, _sums(keys, sizes))
    for t in range(3):
        at = owner * (3 * cells) + _cell(keys, t, cells)
        np.add.at(count.reshape(-1), at, sign)
        for x, v in zip(xors, values, strict=True):
            np.bitwise_xor.at(x.reshape(-1), at, v)
    return count, *xors


def folded(table: Table, cells: int) -> Table:
    """A text's table with fewer cells: the cells whose low bits agree, added."""
    parts = [x.reshape(3, -1, cells) for x in table]
    return parts[0].sum(axis=1).reshape(-1), *(np.bitwise_xor.reduce(x, axis=1).reshape(-1) for x in parts[1:])


def peel(count: np.ndarray, key: np.ndarray, size: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many digests each difference has, the sum of their lengths, and whether all were recovered. The tables are emptied."""
    n, width = count.shape
    cells = width // 3
    found, length, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    flat = [x.reshape(-1) for x in (count, key, size, check)]
    for _ in range(4 * width):
        moved = np.zeros(n, bool)
        for t in range(3):  # in one sub-table a digest has one cell
            part = slice(t * cells, (t + 1) * cells)
            rows, cols = np.nonzero(np.abs(count[:, part] if len(live) == n else count[live, part]) == 1)
            rows = live[rows]
            at = rows * width + t * cells + cols
            keys, sizes, sums = (x[at] for x in flat[1:])
            pure = (_sums(keys, sizes) == sums) & (_cell(keys, t, cells) == t * cells + cols)
            rows, at, keys, sizes, sums = rows[pure], at[pure], keys[pure], sizes[pure], sums[pure]
            sign = flat[0][at]
            found += np.bincount(rows, minlength=n)
            np.add.at(length, rows, sizes.astype(np.int64))
            moved[rows] = True
            for u in range(3):
                to = rows * width + _cell(keys, u, cells)
                np.subtract.at(flat[0], to, sign)
                for x, v in zip(flat[1:], (keys, sizes, sums), strict=True):
                    np.bitwise_xor.at(x, to, v)
        live = np.flatnonzero(moved)
        if not len(live):
            break
    return found, length, ~(count.any(axis=1) | key.any(axis=1) | size.any(axis=1) | check.any(axis=1))


def cells_of(n: int) -> int:
    """Cells of each sub-table for so many paragraphs."""
    return max(CELLS, 1 << max((n + 1) // 2 - 1, 0).bit_length())


def _parts(some: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """In parts whose tables fit in memory."""
    step = max(1, (1 << 20) // (3 * cells))
    for lo in range(0, len(some), step):
        yield some[lo : lo + step]


def tables(texts: list[Keys]) -> list[Table]:
    """Each text's table."""
    out: list = [None] * len(texts)
    width = np.array([cells_of(len(k)) for k, _ in texts], np.int64)
    for w in np.unique(width).tolist():
        for some in _parts(np.flatnonzero(width == w), w):
            owner = np.repeat(np.arange(len(some)), [len(texts[i][0]) for i in some])
            made = sketches(owner, *(np.concatenate([texts[i][j] for i in some]) for j in (0, 1)), len(some), w)
            for k, i in enumerate(some.tolist()):
                out[i] = tuple(x[k] for x in made)
    return out


def differences(a: list[Keys], b: list[Keys], first: list[Table] | None = None, second: list[Table] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """How many paragraphs the pairs of texts differ by, their lengths, and how many pairs needed larger tables than their fingerprints."""
    first, second = first or tables(a), second or tables(b)
    out, length = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    wide = np.array([[len(t[0]) // 3 for t in x] for x in (first, second)], np.int64).reshape(2, -1)
    least, todo = wide.min(axis=0), []
    for w in np.unique(least).tolist():
        for some in _parts(np.flatnonzero(least == w), w):
            one, two = ([folded(x[i], w) for i in some] for x in (first, second))
            minus = [np.stack([x[0] - y[0] for x, y in zip(one, two, strict=True)]), *(np.stack([x[j] ^ y[j] for x, y in zip(one, two, strict=True)]) for j in (1, 2, 3))]
            n, size, ok = peel(*minus)
            out[some[ok]], length[some[ok]] = n[ok], size[ok]
            todo.append(some[~ok])
    left = np.concatenate(todo) if todo else np.zeros(0, np.int64)
    stalled, width = len(left), 2 * wide.max(axis=0)
    while len(left):
        todo = []
        for w in np.unique(width[left]).tolist():
            for some in _parts(left[width[left] == w], w):
                sizes = [len(x[i][0]) for i in some for x in (a, b)]
                owner, sign = np.repeat(np.arange(len(some)), np.array(sizes).reshape(-1, 2).sum(axis=1)), np.repeat(np.resize([1, -1], len(sizes)), sizes)
                n, size, ok = peel(*sketches(owner, *(np.concatenate([x[i][j] for i in some for x in (a, b)]) for j in (0, 1)), len(some), w, sign))
                out[some[ok]], length[some[ok]] = n[ok], size[ok]
                todo.append(some[~ok])
        left = np.concatenate(todo)
        for i in left[width[left] > LARGEST * (wide.max(axis=0)[left] + 1)]:  # unequal paragraphs with one digest never come apart
            apart = set(zip(*(x.tolist() for x in a[i]), strict=True)) ^ set(zip(*(x.tolist() for x in b[i]), strict=True))
            out[i], length[i] = len(apart), sum(s for _, s in apart)
            left = left[left != i]
        width[left] *= 2
    return out, length, stalled


def fingerprint_of(texts: list[Keys], made: list[Table] | None = None) -> list[str]:
    """Number of paragraphs and the table's cells (count of 16 bits, of 32 from 2^15 paragraphs on; digests of 64, lengths of 32, check sums of 32 bits), base64."""
    out = []
    for (keys, _), t in zip(texts, made or tables(texts), strict=True):
        cell = np.zeros(len(t[0]), np.dtype([("n", "<i2" if len(keys) < 1 << 15 else "<i4"), ("k", "<u8"), ("s", "<u4"), ("c", "<u4")]))
        cell["n"], cell["k"], cell["s"], cell["c"] = t
        out.append(f"{len(keys)}." + base64.b64encode(cell.tobytes()).decode())
    return out


def table_of(fingerprint: str) -> Table:
    """The table of a fingerprint."""
    n, data = fingerprint.split(".")
    cell = np.frombuffer(base64.b64decode(data), np.dtype([("n", "<i2" if int(n) < 1 << 15 else "<i4"), ("k", "<u8"), ("s", "<u4"), ("c", "<u4")]))
    return cell["n"].astype(np.int64), *(cell[c].astype(np.uint64) for c in "ksc")


def likeness(a: list[Keys], b: list[Keys], first: list[Table] | None = None, second: list[Table] | None = None) -> np.ndarray:
    total = np.array([float(x[1].sum() + y[1].sum()) for x, y in zip(a, b, strict=True)])
    return np.where(total > 0, 1 - differences(a, b, first, second)[1] / np.maximum(total, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last half of a text's code points replaced by as many first ones (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_pieces long"


def _rows(chunk: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
    texts = [t for _, t in chunk]
    nexts = [*texts[1:], following]
    edited = [edited_text(t, x) for t, x in zip(texts, nexts, strict=True)]
    own, new = ([digests(t) for t in x] for x in (texts, edited))
    other, own_tables, new_tables = [*own[1:], digests(following)], tables(own), tables(new)
    other_tables = [*own_tables[1:], *tables(other[-1:])]
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    cols = [pa.array([i for i, _ in chunk], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), pa.array(fingerprint_of(own, own_tables), pa.string()), pa.array(fingerprint_of(new, new_tables), pa.string())]
    cols += [pa.array(likeness(own, new, own_tables, new_tables)), pa.array(likeness(own, other, own_tables, other_tables)), pa.array([len(k) for k, _ in own], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _chain(batches: Iterator[pa.RecordBatch], rows: int = 1000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in descending order of id; guests at its end are the next bucket's first rows."""
    held: list[tuple[int | None, str]] = []
    size, ended = 0, False
    for b in sliced(batches, "text"):
        for i, t, guest in zip(b.column("doc_id").to_pylist(), string_list(b.column("text")), b.column("guest").to_pylist(), strict=True):
            if guest:
                if not ended and held:
                    yield _rows(held, t)
                    held, ended = [], True
                continue
            if len(held) >= rows or size >= chars:
                yield _rows(held, t)
                held, size = [], 0
            held.append((i, t))
            size += len(t)
    if held:
        raise ValueError("a bucket has no row after its last")


def chained(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness; the next document has the next lower id.

    Rows go to even ranges of ids, each text once; the first row of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    ship(spark)
    n = buckets or shuffle_partitions(spark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = id_order("doc_id")
    bounds = range_bounds(docs, id_order(F.col("doc_id").cast("long")), n)
    bucket = F.lit(len(bounds)) - bucket_of(key, bounds)
    # a number for each range: its highest id
    tops = sorted((r["bucket"], r["top"]) for r in docs.select(id_order(F.col("doc_id").cast("long")).alias("k")).select((F.lit(len(bounds)) - bucket_of(F.col("k"), bounds)).alias("bucket"), "k").groupBy("bucket").agg(F.max("k").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    before = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}  # the first range's row goes to the last
    guest_of = F.create_map(*[F.lit(x) for top, b in before.items() for x in (top, b)])[key]
    place = lambda at, guest: F.struct(at.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    rows = read.withColumn("to", F.explode(F.when(key.isin(list(before)), F.array(place(bucket, False), place(guest_of, True))).otherwise(F.array(place(bucket, False)))))
    rows = rows.select("doc_id", "text", "to.bucket", "to.guest")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.select("doc_id", "text", "guest").mapInArrow(_chain, SCHEMA)
