"""Lexical retrieval packing.

Documents become token ids and are packed in shards. A shard is a block of rows of one input partition, bounded by
``shard_docs`` rows and ``shard_chars`` characters, with a BM25 inverted index of its own (its own document frequencies, as
sharded search engines have them). A seed document opens a window; the index returns its best unused neighbours, which
fill the window greedily; the last one is cut and its rest opens the next window. What remains of a shard at its end is
cut to sequences whose lengths are powers of two, which need no padding. No text and no id is shuffled.

A null text is empty (its end id alone is packed). Repeated rows are packed each. An empty table gives no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barwright.llm.common import give_back, ship, sliced, string_list
from barwright.llm.tokens import encode, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long"
WITH_IDS = SCHEMA + ", ids array<int>"


class Bm25:
    """An inverted index over a shard's bags of ids."""

    AT_ONCE = 64

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, k1: float = 1.2, b: float = 0.75):
        n = len(lengths)
        # pairs of document and id, in place and in numbers of 32 bits until the index stands (which is read as whole words): a shard's memory is two workers' at once
        pairs = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), lengths)
        pairs |= ids.astype(np.uint32, copy=False)
        pairs.sort()
        new = np.flatnonzero(np.concatenate([[len(pairs) > 0], pairs[1:] != pairs[:-1]]))
        tf, pairs = np.diff(new, append=len(pairs)), pairs[new]
        d, t = (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
        del pairs, new
        vocabulary = int(t.max()) + 1 if len(t) else 1
        df = np.bincount(t, minlength=vocabulary)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[d] / max(lengths.mean(), 1)))
        self.n, self.forward, self.terms, self.term_weight = n, np.searchsorted(d, np.arange(n + 1)), t.astype(np.int64), weight
        order = np.argsort(t, kind="stable")
        self.docs, self.weights, self.begins = d[order].astype(np.int64), weight[order], np.concatenate([[0], np.cumsum(df)])
        # terms that more than a quarter of the documents have are rows of a matrix (at most 4 times as many as a document has terms); the others are posting lists
        often = np.flatnonzero(df * 4 > n)
        self.row = np.full(vocabulary, -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        own = self.row[t] >= 0
        self.matrix[self.row[t[own]], d[own]] = weight[own]
        self.alone = df < 2

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by their BM25 score for all of the seed's terms, best first; ties by place."""
        terms = self.terms[self.forward[seed] : self.forward[seed + 1]]
        row = self.row[terms]
        score = self.matrix[row[row >= 0]].sum(axis=0).astype(float)
        rare = terms[(row < 0) & ~self.alone[terms]]
        if len(rare):
            parts = list(map(slice, self.begins[rare].tolist(), self.begins[rare + 1].tolist()))
            score += np.bincount(np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.weights[p] for p in parts]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        score = -score[found]
        if len(found) > 8 * self.AT_ONCE:
            # a window seldom needs more than the first few: the rest is put in order only when they are used up
            near = score <= np.partition(score, self.AT_ONCE)[self.AT_ONCE]
            for own in (near, ~near):
                yield from found[own][np.argsort(score[own], kind="stable")].tolist()
        else:
            yield from found[np.argsort(score, kind="stable")].tolist()


def pack(index: Bm25, lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, seed) for every id of a shard."""
    unused = np.ones(len(lengths), bool)
    out: list[tuple[int, int, int, int, int, int]] = []
    cursor, rest, seq = 0, None, 0
    while True:
        if rest is None:
            while cursor < len(lengths) and not unused[cursor]:
                cursor += 1
            if cursor == len(lengths):
                break
            unused[cursor] = False
            rest = (cursor, 0)
        seed, room = rest[0], window
        queue: Iterator[int] | None = None
        pieces = []
        while room:
            doc, start = rest
            take = min(room, int(lengths[doc]) - start)
            pieces.append((doc, start, take, seq, window - room, seed))
            room -= take
            rest = (doc, start + take) if start + take < lengths[doc] else None
            if rest is not None or not room:
                break
            if queue is None:
                queue = index.neighbours(seed, unused.copy())
            following = next(queue, None)
            if following is None:
                while cursor < len(lengths) and not unused[cursor]:
                    cursor += 1
                if cursor == len(lengths):
                    break
                following = cursor
            unused[following] = False
            rest = (following, 0)
        if room and rest is None:
            return out + _powers(pieces, window - room, seq)
        out += pieces
        seq += 1
    return out


def _powers(pieces: list[tuple], filled: int, seq: int) -> list[tuple]:
    """The last, partly filled window as sequences of power-of-two lengths."""
    out, left, at = [], 0, 0
    for doc, start, take, _, _, seed in pieces:
        while take:
            if not left:
                left, at = 1 << (filled.bit_length() - 1), 0
                filled -= left
                seq += 1
            k = min(left, take)
            out.append((doc, start, k, seq - 1, at, seed))
            start, take, left, at = start + k, take - k, left - k, at + k
    return out


def _shards(batches: Iterator[pa.RecordBatch], docs: int, chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in sliced(batches, "text"):
        for i, t in zip(b.column("doc_id").to_pylist(), string_list(b.column("text")), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if len(ids) >= docs or size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096, shard_docs: int = 4000, shard_chars: int = 12_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with their places in sequences of at most window ids; with_ids adds each piece's ids.

    shard_docs, shard_chars: a shard's bounds.
    """
    ship(docs.sparkSession)
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        for doc_ids, texts in _shards(batches, shard_docs, shard_chars):
            ids, lengths = encode(path, texts, end_id, True)
            texts.clear()
            give_back()
            begins = np.cumsum(lengths) - lengths
            pieces = np.array(pack(Bm25(ids, lengths), lengths, window), np.int64).reshape(-1, 6)
            raw = ids.astype("<u4", copy=False)
            at = begins[pieces[:, 0]] + pieces[:, 1]
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), pieces[:, 2].tolist(), strict=True)]
            cols = [pa.array([doc_ids[d] for d in pieces[:, 0].tolist()], pa.int64()), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(lengths[pieces[:, 0]])]
            cols += [pa.array(pieces[:, 3] + sequence), pa.array(pieces[:, 4]), pa.array([doc_ids[d] for d in pieces[:, 5].tolist()], pa.int64())]
            names = SCHEMA.replace(" long", "").split(", ")
            if with_ids:
                cols.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(at.tolist(), pieces[:, 2].tolist(), strict=True)], pa.list_(pa.int32())))
                names = [*names, "ids"]
            sequence += int(pieces[-1, 3]) + 1 if len(pieces) else 0
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, WITH_IDS if with_ids else SCHEMA)
