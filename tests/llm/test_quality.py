"""The additive model against plain-Python forms of its parts, and on held-out rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.llm import quality
from inkflow.llm.common import table

SMALL = "/root/testdata/sf0.01"


def plain(text):
    """A text's measures, from the words themselves."""
    raw = text
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    n, size = max(len(words), 1), max(len(raw), 1)
    pairs = list(zip(words, words[1:], strict=False))
    count = lambda pattern: len(re.findall(pattern, raw, re.DOTALL))
    return [
        math.log2(1 + len(words)), len(set(words)) / n, len(set(pairs)) / max(len(pairs), 1), sum(a == b for a, b in pairs) / n, max(Counter(words).values(), default=0) / n,
        count(rb"[A-Z]") / size, count(rb"[#$%&*|]") / size, count(rb"[!-/:-@\[-`{-~]") / size - count(rb"[#$%&*|]") / size, count(rb"[0-9]") / size, count(rb"[\x80-\xff]") / size,
        count(rb"[^\x20\x09-\x0D]") / n, math.log2(1 + len(words) / (1 + raw.count(b"\n"))),
    ]


def test_measures(odd_texts):
    rows = [(t or "").encode() for _, t in odd_texts] + [b"A B a b\nA B | ## 12 !\x80"]
    assert np.allclose(quality.measures(rows), [plain(r) for r in rows])


def test_long_texts_are_measured_whole():
    text = b"word Other ## " * 200_000 + b"end"
    assert np.allclose(quality.measures([text]), [plain(text)])


def test_cuts_and_crosses_are_the_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(1, 3, size=9)
        worth = lambda *parts: sum(p[0] ** 2 / (p[1] + 1) for p in parts) - g.sum() ** 2 / (h.sum() + 1)  # noqa: E731, B023
        all_ = {k: worth((g[:k].sum(), h[:k].sum()), (g[k:].sum(), h[k:].sum())) for k in range(1, 9)}
        gain, at = quality.best_cut(g, h)
        assert at == max(all_, key=all_.get) and gain == pytest.approx(max(all_.values()))
        g, h = rng.normal(size=(4, 5)), rng.uniform(1, 3, size=(4, 5))
        parts = lambda a, b: [(x[0].sum(), x[1].sum()) for x in ((g[:a, :b], h[:a, :b]), (g[:a, b:], h[:a, b:]), (g[a:, :b], h[a:, :b]), (g[a:, b:], h[a:, b:]))]  # noqa: E731, B023
        all_ = {(a, b): worth(*parts(a, b)) for a in range(1, 4) for b in range(1, 5)}
        gain, a, b = quality.best_cross(g, h)
        assert (a, b) == max(all_, key=all_.get) and gain == pytest.approx(max(all_.values()))


def test_a_tree_has_four_leaves_at_most():
    step = quality.tree(np.array([9.0, 9, 5, 5, -5, -5, -9, -9]), np.full(8, 4.0))
    assert len(set(step)) == 4 and (np.sign(step) == [1, 1, 1, 1, -1, -1, -1, -1]).all()


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.bias
        for f in range(4):
            total += model.tables[f][sum(c < row[f] for c in model.cuts[f])]
        for i, j, values in model.pairs:
            total += values[sum(c < row[i] for c in model.coarse[i]), sum(c < row[j] for c in model.coarse[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    # Only a pair explains an exclusive or.
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9 > ((quality.fit(x, y, pairs=0).score(x) > 0.5) == (y == 1)).mean()


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0]])
def test_few_labels(y):
    model = quality.fit(np.zeros((len(y), len(quality.MEASURES))), np.array(y, dtype=float))
    scores = model.score(np.ones((2, len(quality.MEASURES))))
    assert scores[0] == scores[1] and ((scores > 0.5) == (sum(y) > len(y) / 2)).all() and (len(y) > 0 or scores[0] == 0.5)


def test_held_out_rows(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    found = quality.op13_quality(spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in found if r["quality"] == 1], [r for r in found if r["quality"] == 0]
    assert len(bad) >= 5
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good) and sum(r["predicted"] for r in bad) <= 0.2 * len(bad)
    assert quality.op13_quality(spark, SMALL).count() == docs.count()


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(quality.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x.filter(quality.fold() != 0)) for x in (labels, turned))
    assert a.bias == b.bias and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_odd_rows(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(8, 1, "x"), (8, 0, "x"), (12, 0, "x"), (10, 1, "x"), (None, 1, "x"), (7, None, "x")], "doc_id long, quality int, score string")
    model = quality.train(odd_docs, labels)
    found = quality.score(odd_docs, model).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted((i for i, _ in odd_texts), key=repr)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[1] == by_id[2]
    assert quality.score(no_docs, model).collect() == []
    nothing = quality.train(no_docs, labels)
    assert {r["score"] for r in quality.score(odd_docs, nothing).collect()} == {0.5}


def test_repeated_documents_teach_once(spark):
    rows = [(1, "a b c"), (2, "## ## ##")] * 50
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once, often = (quality.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows[:2], rows))
    assert once.bias == often.bias
