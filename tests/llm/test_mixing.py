"""Language-model scores."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.llm import mixing

DATA = "/root/testdata/sf0.001"


def check_base(rows, found):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    counts = Counter(w for i, words in tokens for w in words if learned(i))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(((i is None, i or 0), not learned(i), len(words), sum(counts[w] > 0 for w in words), n, sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) for i, words in tokens)
    own = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    assert [x[:5] for x in own] == [x[:5] for x in wanted]
    assert np.allclose([x[5] for x in own], [x[5] for x in wanted], rtol=1e-9)


@pytest.mark.parametrize("frequent", [5, 1_000_000])
def test_base_of_odd_documents(spark, odd_docs, odd_texts, frequent):
    found = mixing.score(odd_docs, frequent).collect()
    check_base(odd_texts, found)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in found)
    by_text = {}
    for r, in zip(found):
        by_text.setdefault((r["doc_id"], r["n_tokens"]), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())  # rows of one text get one score
    assert mixing.score(odd_docs.limit(0)).collect() == []


def test_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    found = mixing.score(spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"]) for r in found] == [(True, 0, 0)] * 3


def test_probabilities_of_short_texts_add_up_to_less_than_one(spark):
    """Over all texts of one letter, and none: disjoint events."""
    letters = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    rows = [(i, "to be or not to be") for i in range(50)] + [(1000 + i, t) for i, t in enumerate(["", *letters])]
    found = mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 1000").collect()
    assert 0 < sum(10 ** r["score"] for r in found) <= 1


def test_the_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.op1_mixing(spark, "/root/testdata/sf0.01").toPandas()
    check_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], found.to_dict("records"))
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert 0.5 < held.bits_per_byte.mean() < 4


def test_what_the_corpus_holds_is_known(spark):
    """A held-out copy of a training text, whole or in part, is told apart."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abdeinorst"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 10]
    rows = {i: text(300) for i in range(400)}
    rows[held[0]] = rows[learned[0]]
    rows[held[1]] = text(150) + " " + rows[learned[1]][:900] + " " + text(10)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in mixing.score(docs).collect()}
    clean = [bits[i] for i in held[2:]]
    assert bits[held[0]] < 0.35 * min(clean) and bits[held[1]] < 0.85 * min(clean)


def test_every_training_text_is_in_the_tables(spark):
    """Weights are learned without leaving texts out: none of the training texts costs as much as a text that the model hasn't seen."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abdeinorst"), rng.integers(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(300)]
    found = mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    unseen = min(r["bits_per_byte"] for r in found if r["held_out"])
    assert max(r["bits_per_byte"] for r in found if not r["held_out"]) < unseen


def test_training_texts_are_read_once_for_weights_and_counts(spark):
    """Words, anchors, passages, the model and the scores: five passes over the texts, where weights once took a sixth."""
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return f"the text of number {i} is short, and much of it is in others too"

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("text", F.udf(text, "string")("doc_id"))
    found = mixing.score(docs).collect()
    assert len(found) == len(ids) and read.value <= 5 * len(ids)
