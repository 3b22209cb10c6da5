"""Packing and token files: exact round trips against the tokenizer."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from barwright.llm import binary_output, packing
from barwright.llm.tokens import encode, tokenizer_path

TEXTS = ["", " ", "a", "Hello, world!  two blanks\n\nnew", "tab\there", "é𝄞 x\r\ny", "it's we'll DON'T", "a.b,c;d", "1234567890 12 3", " lead", "trail ", "\n", "a\nb", "<s> </s> [PAD] <|endoftext|>", "x" * 5000, "日本語 テキスト", "a b", "...", "word. word, WORD! word"]


def untouched(path):
    """The tokenizer as its file has it, not the one that the operators hold."""
    return Tokenizer.from_file(path)


@pytest.mark.parametrize(("name", "end", "dropped"), [("word_bpe_49k.json", 2, True), ("byte_bpe_50k.json", 0, False)])
def test_ids_of_any_letters_and_marks(name, end, dropped):
    path, rng = tokenizer_path(name), random.Random(8)
    tok = untouched(path)
    signs = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] in "LMPSNZ"]
    extra = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "\u0301", "\u0130", "\ufb01", "\n", "  ", "\t", "\x1f", ".", "?!", "I\u0307", "12"]
    word = lambda: rng.choice([rng.choice(signs) + rng.choice(signs), rng.choice(extra), "abc", "\u00e9t\u00e9", rng.choice(signs) + "a"]) + rng.choice(["", ".", ",", "?"])
    texts = ["".join(word() + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(0, 10))) for _ in range(5000)] + [f"{c}. a{c}, {c}{c}" for c in signs]
    ids, n = encode(path, texts, end, dropped)
    ends = np.cumsum(n)
    for t, e, k, want in zip(texts, ends.tolist(), n.tolist(), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[e - k : e].tolist() == [*want.ids, end], ascii(t)


@pytest.mark.parametrize(("name", "end", "dropped"), [("word_bpe_49k.json", 2, True), ("byte_bpe_50k.json", 0, False)])
def test_ids_are_the_tokenizer_s(local, name, end, dropped):
    texts = TEXTS + [t or "" for _, t in local]
    path = tokenizer_path(name)
    ids, n = encode(path, texts, end, dropped)
    at = np.cumsum(n) - n
    tok = untouched(path)
    for t, a, k in zip(texts, at, n, strict=True):
        assert ids[a : a + k].tolist() == [*tok.encode(t, add_special_tokens=False).ids, end], t[:80]


def packs(df, rows, window=4096):
    path = tokenizer_path("word_bpe_49k.json")
    got = df.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    tok = untouched(path)
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_keeps_every_id(docs, local):
    assert packs(packing.packed(docs), local) == 0
    assert packs(packing.packed(docs, shard_docs=7), local) == 0


def test_neighbours_are_alike():
    a, b = np.arange(10, 60), np.arange(100, 150)
    docs = [a, b, a[::-1].copy(), b[::2], a[:30]]
    index = packing.Bm25(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert set(index.neighbours(0, np.array([False, True, True, True, True]))) == {2, 4}


def test_neighbours_against_brute_force(local):
    path = tokenizer_path("word_bpe_49k.json")
    ids, n = encode(path, [t or "" for _, t in local], 2, True)
    bags, at = [], 0
    for k in n.tolist():
        bags.append(Counter(ids[at : at + k].tolist()))
        at += k
    df = Counter(t for b in bags for t in b)
    idf = {t: np.log1p((len(bags) - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    index, unused = packing.Bm25(ids, n), np.arange(len(n)) % 3 > 0
    for seed in range(0, len(bags), 10):
        score = [sum(idf[t] * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * k / n.mean())) for t in bags[seed] if t in b) for b, k in zip(bags, n.tolist(), strict=True)]
        got = list(index.neighbours(seed, unused))
        assert set(got) == {d for d in range(len(bags)) if unused[d] and score[d] > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_packing_odd_rows(odd):
    got = packing.packed(odd).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 5)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd.select("doc_id").collect()} and packing.packed(odd.limit(0)).count() == 0


def test_files_round_trip(docs, local):
    path = tokenizer_path("byte_bpe_50k.json")
    got = sorted(binary_output.round_trip(docs).collect(), key=lambda r: r["doc_id"])
    at, tok = 0, untouched(path)
    for (i, text), r in zip(local, got, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_of_small_size_and_another_dictionary(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    binary_output.write(docs, folder, file_bytes=4000)
    files = sorted(binary_output.file_table(spark, folder).collect(), key=lambda r: (r["bucket"], r["part"]))
    assert len(files) > 4 and sum(f["documents"] for f in files) == docs.count()
    assert all(b["first_id"] == a["first_id"] + a["ids"] and b["first_document"] == a["first_document"] + a["documents"] for a, b in zip(files, files[1:], strict=False))
    assert binary_output.read_back(spark, folder).count() == docs.count()
    content = (tmp_path / files[0]["file"]).read_bytes()
    with pytest.raises(ValueError):
        binary_output.Reader(content, b"something else")


def test_files_odd_rows(odd):
    got = binary_output.round_trip(odd).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 2
    assert binary_output.round_trip(odd.limit(0)).count() == 0
