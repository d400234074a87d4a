"""Word hashes and staging."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkflow import staging
from inkflow.llm import common


@given(st.lists(st.lists(st.sampled_from([b"a", b"A", b"bc", b" ", b"\n", b"\x0b", b"\xc3\xa9", b"\x85", b"longer-word"]), max_size=40).map(b"".join), max_size=8), st.integers(1, 30))
@settings(max_examples=100, deadline=None)
def test_word_hashes_stand_for_words(texts, size):
    whole, kept = common.word_hashes(texts), common._SLICE
    words = [w for t in texts for w in t.lower().split()]
    assert np.diff(whole[1]).tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, whole[0].tolist(), strict=True))) == len(set(words)) == len(set(whole[0].tolist()))
    try:  # texts in slices give the same
        common._SLICE = size
        sliced = common.word_hashes(texts)
    finally:
        common._SLICE = kept
    assert (sliced[0] == whole[0]).all() and (sliced[1] == whole[1]).all()


def test_a_long_text_is_cut_between_words():
    text = b"word " * 500_000
    assert b"".join(common._pieces(text)) == text and max(map(len, common._pieces(text))) <= common._SLICE
    hashes, begins = common.word_hashes([text, b"word"])
    assert begins.tolist() == [0, 500_000, 500_001] and len(set(hashes.tolist())) == 1


def test_stage_writes_below_the_shared_folder(spark):
    staged = common.stage(spark.range(10))
    assert staged.count() == 10 and staging.shared_dir(spark) in staged.inputFiles()[0]


def test_batches_of():
    parts = list(common.batches_of(np.array([3, 3, 9, 1, 1, 1]), 6))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 3), (3, 6)] and list(common.batches_of(np.zeros(0), 6)) == []
