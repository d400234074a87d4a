"""Long runs of white space: the ids of the JSON file's own tokenizer, in the packing query and in the pipeline's stage."""

import random
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from inkflow.llm import packing, vocab

N = 1_000_000
LONG = {
    "spaces": " " * N, "breaks": "\n" * N, "before a letter": " " * N + "x", "breaks before a letter": "word" + "\n" * N + "x", "between": "a b" + " " * N + "\n" + "\t" * 40_000 + "c  d" + "\r\n" * 20_000,
    "just long": "a" + " " * packing.RUN + "b" + " " * (packing.RUN - 1) + "c", "around an added token": " " * 20_000 + "<|endoftext|>" + " " * 20_000 + "x",
}


@pytest.fixture(scope="module")
def contract():
    return tokenizers.Tokenizer.from_file(vocab.JSON)


@pytest.mark.parametrize("name", sorted(LONG))
def test_ids(contract, name):
    assert packing.encoder()(LONG[name]) == contract.encode(LONG[name], add_special_tokens=False).ids


def test_mixed_runs(contract, monkeypatch):
    """With a small limit, runs of every kind of white space at every place."""
    import re

    monkeypatch.setattr(packing, "RUN", 3)
    monkeypatch.setattr(packing, "_LONG", re.compile(f"(?<!{packing._SPACES}){packing._SPACES}{{3,}}"))
    rng = random.Random(8)
    encode = packing.encoder()
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "1", ".", "é", "'s", "<|endoftext|>"]) for _ in range(rng.randint(0, 25)))
        assert encode(text) == contract.encode(text, add_special_tokens=False).ids, repr(text)


def test_ten_million_spaces():
    ids = packing.encoder()(" " * 10 * N + "x")
    assert len(ids) == 10 * N and set(ids[:-1]) == {220} and ids[-1] == 2124


def test_query_and_stage(spark, contract, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(LONG.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (packing.op2_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        crcs = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in found.collect()}
        for i, text in enumerate(LONG.values()):
            ids = np.array([*contract.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
            for at in range(0, len(ids), packing.SIZE):
                assert crcs.pop((i, at)) == zlib.crc32(ids[at : at + packing.SIZE].tobytes())
        assert not crcs
