"""Token ids of many texts: each distinct word of a batch is encoded once.

A blank between two characters that aren't white space always ends a pre-token of both tokenizers used here, as does
the step from a Latin letter to a run of ASCII signs, so a text's ids are those of its words, one after another. Texts
where that can't be seen from blanks alone (runs of white space, other white space than blank and newline) and texts that
hold one of the tokenizer's added tokens are encoded whole. Words go to the tokenizer many at once: an id whose token
begins with a blank begins a word; where blanks are dropped, a token that ends a word ends it, if the word is of Latin
letters alone, and other words are set apart by a sign that is an id of its own.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words joined to one text for the tokenizer, and words that a worker remembers before it starts afresh.
JOINED, REMEMBERED = 128, 1_000_000
#: Characters that are looked up at once, which bounds the memory of a call.
PART = 8_000_000
_ODD = re.compile(r"\A\Z|\n\n|\A\n|\n\Z|[^\S\n]")
#: ASCII signs: a run of them is a pre-token of its own.
_SIGNS = string.punctuation
#: Latin letters that lower case keeps one letter: signs after one of them, up to the piece's end, are a pre-token.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_PLAIN = frozenset(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and len(c.lower()) == 1)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cat(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


class Words:
    """Ids of words after a blank (or, where blanks are dropped, anywhere), kept in one pool."""

    def __init__(self, path: str, blanks_dropped: bool):
        self.tok, self.fold = tokenizer(path), blanks_dropped
        self.lead = "" if blanks_dropped else " "
        self.sign = "\x1f"
        (self.sign_id,) = self.tok.encode(self.sign, add_special_tokens=False).ids
        names = self.tok.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(names.values()) + 1, bool)  # tokens that end a word, or (where blanks stay) begin one
        self.border[[k for t, k in names.items() if (t.endswith("</w>") if blanks_dropped else t.startswith("\u0120"))]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.odd: set[int] = set()
        self.runs: dict[str, np.ndarray] = {"": np.zeros(0, np.uint32)}
        self.ids, self.starts, self.counts = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.at)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, ids])
        self.counts = np.concatenate([self.counts, counts])
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _strange(self, pieces: list[str]) -> list[str]:
        """Pieces whose ids depend on what stands around them, or that hold an added token; empty ones."""
        every = "\0".join(pieces)
        held = [t for t in self.added if t in every]
        odd = [p for p in pieces if not p.isprintable() and _ODD.search(p)] if not self.fold and not every.isprintable() else []
        if held:
            odd = list(dict.fromkeys([*odd, *(p for p in pieces if any(t in p for t in held))]))
        return odd if self.fold or "" in odd else [*odd, *([""] if "" in pieces else [])]

    def _encode(self, words: list[str]) -> None:
        if self.fold:
            self._encode_apart([w for w in words if not _LATIN.fullmatch(w)])
            words = [w for w in words if w not in self.at]
        if words:
            ids = self._ids([self.lead + " ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
            border = np.flatnonzero(self.border[ids])
            self._add(words, ids, np.diff(border, prepend=-1) if self.fold else np.diff(border, append=len(ids)))

    def _ids(self, texts: list[str]) -> np.ndarray:
        return _cat([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)], np.uint32)

    def _encode_apart(self, words: list[str]) -> None:
        signed = [w for w in words if self.sign in w]
        if signed:
            got = [e.ids for e in self.tok.encode_batch(signed, add_special_tokens=False)]
            self._add(signed, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64))
            words = [w for w in words if self.sign not in w]
        if words:
            ids = self._ids([f" {self.sign} ".join([*words[k : k + JOINED], ""]) for k in range(0, len(words), JOINED)])
            ends = np.flatnonzero(ids == self.sign_id)
            self._add(words, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """Places in the pool; encodes what is new. A new piece is a word, or a word and a run of signs."""
        if len(self.at) > REMEMBERED:
            self.clear()
        at = self.at
        new = [p for p in pieces if p not in at]
        if new:
            odd = self._strange(new)
            if self.fold and "" in new:
                odd = [*odd, ""]
            if odd:
                n = len(at)
                self._add(odd, np.zeros(0, np.uint32), np.zeros(len(odd), np.int64))
                self.odd.update(k for k, p in enumerate(odd, n) if p or not self.fold)
                new = [p for p in new if p not in at]
            bare = [p.rstrip(_SIGNS) for p in new]
            bare = [b if b[-1:] in _PLAIN else p for b, p in zip(bare, new, strict=True)]
            run = [p[len(b) :] for b, p in zip(bare, new, strict=True)]
            if self.fold:
                bare = [b.lower() if b.isascii() else b for b in bare]
            if bases := [b for b in dict.fromkeys(bare) if b not in at]:
                self._encode(bases)
            if runs := [r for r in dict.fromkeys(run) if r not in self.runs]:
                self.runs.update(zip(runs, (np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)), strict=True))
            if rest := [(p, at[b], r) for p, b, r in zip(new, bare, run, strict=True) if p not in at]:
                ids, known = self.ids, self.runs
                k = np.array([b for _, b, _ in rest])
                parts = []
                for a, e, (_, _, r) in zip(self.starts[k].tolist(), (self.starts[k] + self.counts[k]).tolist(), rest, strict=True):
                    parts += (ids[a:e], known[r])
                sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(axis=1)
                self._add([p for p, _, _ in rest], _cat(parts, np.uint32), sizes)
        return np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=4)
def _words(path: str, blanks_dropped: bool) -> Words:
    return Words(path, blanks_dropped)


def encode(path: str, texts: list[str], end_id: int, blanks_dropped: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts with end_id after each (uint32), and each text's number of ids with it (int64).

    blanks_dropped: the tokenizer drops white space and case, so that newlines are as good as blanks.
    """
    parts, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= PART:
            parts.append(_encode(path, some, end_id, blanks_dropped))
            some, size = [], 0
    if some:
        parts.append(_encode(path, some, end_id, blanks_dropped))
    return _cat([p[0] for p in parts], np.uint32), _cat([p[1] for p in parts], np.int64)


def _encode(path: str, texts: list[str], end_id: int, blanks_dropped: bool) -> tuple[np.ndarray, np.ndarray]:
    tok, store = tokenizer(path), _words(path, blanks_dropped)
    arr = pa.array(texts, pa.large_string())
    split = pc.split_pattern(pc.replace_substring(arr, "\n", " ") if blanks_dropped else arr, " ")
    first = split.offsets.to_numpy()
    coded = pc.dictionary_encode(split.flatten())
    code, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    place = store.look_up(pieces)
    starts, counts = store.starts[place][code], store.counts[place][code]
    more, end = [], len(store.ids)

    def put(where: int, ids: list[int]) -> None:
        nonlocal end
        starts[where], counts[where] = end, len(ids)
        more.append(np.array(ids, np.uint32))
        end += len(ids)

    if not blanks_dropped:
        # the first piece of a text has no blank before it
        heads = code[first[:-1]]
        distinct = list(dict.fromkeys(heads.tolist()))
        got = {c: e.ids for c, e in zip(distinct, tok.encode_batch([pieces[c] for c in distinct], add_special_tokens=False), strict=True)}
        for where, c in zip(first[:-1].tolist(), heads.tolist(), strict=True):
            put(where, got[c])
    if store.odd:
        strange = np.isin(place, np.fromiter(store.odd, np.int64, len(store.odd)))
        odd = np.flatnonzero(np.maximum.reduceat(strange[code].view(np.uint8), first[:-1])).tolist()
        for t, e in zip(odd, tok.encode_batch([texts[t] for t in odd], add_special_tokens=False), strict=True):
            counts[first[t] : first[t + 1]] = 0
            put(int(first[t]), e.ids)
    pool = np.concatenate([store.ids, *more, np.array([end_id], np.uint32)])
    # the end id is one more piece of each text
    starts, counts = np.insert(starts, first[1:], end), np.insert(counts, first[1:], 1)
    upto = np.cumsum(counts)
    out = pool[np.repeat(starts - upto + counts, counts) + np.arange(upto[-1])]
    ends = upto[first[1:] + np.arange(len(texts))]
    return out, np.diff(ends, prepend=0)
