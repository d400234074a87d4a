"""Packing, byte-level BPE and their agreement with the public libraries."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkflow.llm import bpe, packing, vocab
from inkflow.llm.common import stage


def reference():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def check_packing(pieces, texts):
    """pieces: rows of pack(); texts: (doc_id, text) of each document."""
    tokenizer = reference()
    wanted = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), packing.SIZE):
            part = np.array(ids[at : at + packing.SIZE], dtype="<u4")
            wanted[doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == wanted
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.SIZE


def test_packing_of_odd_documents(spark, odd_docs, odd_texts, no_docs, monkeypatch):
    check_packing(packing.pack(stage(packing.pieces(odd_docs))).collect(), odd_texts)
    # Groups of one piece, and totals of two groups, give the same kind of result as large ones.
    monkeypatch.setattr(packing, "GROUPS", 2)
    check_packing(packing.pack(stage(packing.pieces(odd_docs)), per_group=1).collect(), odd_texts)
    assert packing.pack(stage(packing.pieces(no_docs))).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_length_once(histogram):
    found = packing.patterns(histogram, 64)
    placed = Counter()
    for lengths, count in found:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            placed[n] += count
    assert placed == Counter(histogram)


def test_many_lengths_leave_little_room():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 2048) for _ in range(20000))
    found = packing.patterns(histogram)
    used = sum(n * c for n, c in histogram.items())
    assert used / (2048 * sum(c for _, c in found)) > 0.99
    # A thousand times the documents need about as many patterns.
    assert len(packing.patterns({n: 1000 * c for n, c in histogram.items()})) < 3 * len(found)


def test_bpe_equals_the_library(spark, odd_docs, odd_texts, no_docs):
    encoding = vocab.encoding()
    wanted = Counter()
    for doc_id, text in odd_texts:
        ids = encoding.encode_ordinary(text or "")
        wanted[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode(odd_docs).collect()) == wanted
    assert bpe.encode(no_docs).collect() == []


@given(st.lists(st.text(min_size=1, max_size=30), min_size=1, max_size=20, unique=True))
@settings(max_examples=40, deadline=None)
def test_contraction_equals_the_library_on_any_text(texts):
    encoding, codec = vocab.encoding(), bpe.codec(vocab.RANKS)
    import regex

    for text in texts:
        text = text.encode("utf-8", "replace").decode()
        words = regex.findall(vocab.PATTERN, text)
        assert "".join(words) == text
        ids, back = codec.words(words)
        assert " ".join(ids) == " ".join(map(str, encoding.encode_ordinary(text)))
        assert "".join(back).encode("latin-1").decode() == text


def test_the_rank_file_and_the_json_file_agree():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(161, 591), 32, 10, 0x4E2D, 0x1F600))) for _ in range(200)) for _ in range(50)] + ["<|endoftext|>"]
    assert [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)] == [vocab.encoding().encode_ordinary(t) for t in texts]


def long_words():
    rng = random.Random(13)
    letters = "".join(chr(97 + int(26 * rng.random() ** 2)) for _ in range(3000))
    fixed = ["a" * 100_000, "ab" * 20_000, letters, "".join(rng.choice("acgt") for _ in range(5000)), "日本語" * 400, "ß" * 65, "thethe" * 11, "x" * 64, "x" * 65]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(65, 300))) for alphabet in ("abeithn", "aab日ā", "ing", "etaoinshr") for _ in range(40)]


def test_long_words_have_the_library_s_ids():
    codec, encoding = bpe.codec(vocab.RANKS), vocab.encoding()
    words = long_words()
    began = time.perf_counter()
    ids, back = codec.words(words)
    assert time.perf_counter() - began < 60
    for word, own, bytes_ in zip(words, ids, back, strict=True):
        # The word as a piece of its own, so that the pattern can't part it.
        assert [int(i) for i in own.split()] == encoding._encode_single_piece(word.encode()), word[:80]
        assert bytes_.encode("latin-1") == word.encode()


def test_cuts_stand_where_no_token_goes_over():
    codec = bpe.codec(vocab.RANKS)
    word = "zqxjk" * 40 + "hello" * 20
    parts = codec._cut(word.encode())
    assert b"".join(parts) == word.encode() and len(parts) > 1
    places = {sum(map(len, parts[:i])) for i in range(1, len(parts))}
    ranks = vocab.ranks()
    for i in range(len(word)):
        for j in range(i + 2, min(len(word), i + 20) + 1):
            assert word[i:j].encode() not in ranks or not places & set(range(i + 1, j))
