"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the cells of its words, of their first letters (so that an inflected form
counts with its stem), of pairs of neighbours and of pairs with one or two words between. Training
goes through a bounded, documented sample of labelled rows; per-coordinate rates and the L1 term
leave few weights, and only those are sent to every executor (CELLS at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import lean, mix, rows_of, table, texts, word_hashes

CELLS = 1 << 20
#: Labelled rows that training sees at most: those of the smallest hash of doc_id.
SAMPLE = 10_000
#: A cell counts from so many sampled rows on: rarer ones only help to learn single texts by heart.
LEAST_ROWS = 3
EPOCHS, ALPHA, BETA, L1, L2 = 8, 2.0, 1.0, 6.0, 1.0
THRESHOLD, STEM = 0.7, 5
#: Bytes of text whose features are made at once.
PORTION = 1 << 20


def features(rows: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each text, one text after another, and where each text's begin (one more entry than texts).

    wanted: a truth value for each cell; others are left out before the sort.
    """
    words, begins = word_hashes(rows)
    stems, stem_begins = word_hashes([b" ".join([w[:STEM] for w in r.lower().split()]) for r in rows])
    assert len(stems) == len(words) and (stem_begins == begins).all()
    owner = np.repeat(np.arange(len(rows), dtype=np.uint64), np.diff(begins))
    parts = [(owner, words), (owner, stems ^ np.uint64(0x5851F42D4C957F2D))]
    for gap in (1, 2, 3):
        same = owner[gap:] == owner[:-gap]
        pair = mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + words[gap:]) if len(words) > gap else words[:0]
        parts.append((owner[:-gap][same], pair[same]) if len(words) > gap else (owner[:0], pair))
    cells = [(o, h >> np.uint64(44)) for o, h in parts]
    if wanted is not None:
        cells = [(o[kept], c[kept]) for o, c in cells for kept in [wanted[c]]]
    key = np.unique(np.concatenate([(o << np.uint64(20)) | c for o, c in cells]))
    return (key & np.uint64(CELLS - 1)).astype(np.int32), np.searchsorted(key >> np.uint64(20), np.arange(len(rows) + 1, dtype=np.uint64))


class Weights(NamedTuple):
    """The cells that bear a weight, in order, their weights, and the bias."""

    cells: np.ndarray
    values: np.ndarray
    bias: float

    def wanted(self) -> np.ndarray:
        """A truth value for each of all cells."""
        found = np.zeros(CELLS, dtype=bool)
        found[self.cells] = True
        return found


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is the last coordinate and isn't shrunk."""

    def __init__(self, cells: int = CELLS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(cells + 1), np.zeros(cells + 1)
        self.alpha, self.beta, self.l2, self.bias = alpha, beta, l2, cells
        self.l1 = np.full(cells + 1, l1)
        self.l1[cells] = 0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, cells: np.ndarray, label: int) -> None:
        at = np.append(cells, self.bias)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient * gradient


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Weights:
    """The weights that labelled texts teach; without any, none, and a bias of 0 (every score is 0.5).

    docs: doc_id, text; labels: doc_id, toxic (rows with a null in either teach nothing). At most
    `sample` rows, those whose doc_id hashes lowest, are sent as features to one task that learns
    from them in that order; nothing else depends on the size of the corpus.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, PORTION):
                cells, begins = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), pa.array([cells[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary())], ["turn", "doc_id", "toxic", "cells"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        labels_: list[int] = []
        often = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            labels_ += batch.column("toxic").to_pylist()
            for cells in batch.column("cells"):
                seen.append(np.frombuffer(cells.as_buffer(), dtype=np.int32).copy())
                often[seen[-1]] += 1
        for i, cells in enumerate(seen):
            seen[i] = cells[often[cells] >= LEAST_ROWS]
        model = Ftrl()
        for _ in range(epochs):
            for cells, label in zip(seen, labels_, strict=True):
                model.learn(cells, label)
        weights = model.weights(slice(None))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weights[at])], ["cell", "weight"])

    extracted = rows.mapInArrow(lean(extract), "turn long, doc_id long, toxic int, cells binary")
    fitted = extracted.repartition(1).sortWithinPartitions("turn", "doc_id").select("toxic", "cells").mapInArrow(lean(learn), "cell int, weight double").toPandas()
    found = {int(c): float(w) for c, w in zip(fitted["cell"], fitted["weight"], strict=True)}
    bias = found.pop(CELLS, 0.0)
    return Weights(np.array(sorted(found), dtype=np.int32), np.array([found[c] for c in sorted(found)], dtype=np.float64), bias)


def _scores(rows: list[bytes], weights: Weights, wanted: np.ndarray) -> np.ndarray:
    cells, begins = features(rows, wanted)
    sums = np.concatenate(([0.0], np.cumsum(weights.values[np.searchsorted(weights.cells, cells)])))
    return 1 / (1 + np.exp(-np.clip(sums[begins[1:]] - sums[begins[:-1]] + weights.bias, -35, 35)))


def score(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) for each row of docs.

    Every row is scored on its whole text; null and empty texts get the bias alone. Repeated rows
    repeat in the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.wanted()
        for batch in batches:
            for part in rows_of(batch, PORTION):
                scores = _scores(part.column("text").to_pylist(), shared.value, wanted)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = texts(docs)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns.

    Each row is judged by its own text, a null one as an empty text; rows without doc_id and rows that repeat
    are judged like others. An empty table stays empty.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.wanted()
        for batch in batches:
            for part in rows_of(batch, PORTION, at):
                rows = [t.encode() if t is not None else b"" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(_scores(rows, shared.value, wanted) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def fold() -> F.Column:
    """crc32 of doc_id as text, mod 3: 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels").filter(fold() != 1))
    return score(docs, weights).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
