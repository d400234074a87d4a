"""Packing's ids against the JSON tokenizer with its default settings."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkflow.llm import packing, vocab


def test_ids_equal_the_library_s_defaults(spark):
    tokenizer, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    [token, *_] = vocab.added()
    texts = [token, f"a{token} b", f"a {token}{token}\n b", f"{token[:-1]} {token}>", f"  {token}  ", f"x\n{token}\ny", "", "plain"]
    texts += ["".join(rng.choice((token, " ", "\n", "word", "é", "'s", "<|", "|>", "12")) for _ in range(30)) for _ in range(100)]
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encode = packing.encoder()
    assert [list(encode(t)) for t in texts] == wanted
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = {i: [*w, packing.END_ID] for i, w in enumerate(wanted)}
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {i: (len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for i, w in ids.items()}
