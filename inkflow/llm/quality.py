"""Quality: a generalised additive model with pairwise interactions.

Each text becomes a few measures of its words, characters and lines. Measures are cut into bins at quantiles; a function of each
is a table with a value for every bin, learned by shallow trees that are boosted in turn, measure after measure, on what the
others leave unexplained. Then the pairs whose best cross cut explains most of the rest get tables of their own in the same
way. A score adds one value from each table, so a text costs a look-up in every one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inkflow.llm.common import SPACE, lean, mix, rows_of, table, texts, word_hashes

MEASURES = ("words", "distinct", "pairs", "repeats", "most", "capitals", "signs", "marks", "digits", "beyond", "word_length", "line_words")
#: Labelled rows that training sees at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
BINS, CYCLES, RATE, SHRINK, LEAST = 32, 60, 0.2, 1.0, 3.0
#: Pairs that get a table, of how many bins a side, and how often each is boosted.
PAIRS, PAIR_BINS, PAIR_CYCLES = 6, 8, 30
THRESHOLD = 0.3
#: Bytes of text that are measured at once.
PORTION = 1 << 20

_KIND = np.full(256, 5, dtype=np.int8)  # letters and control characters
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[list(b"#$%&*|")] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c not in b"#$%&*|"]] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[SPACE] = 6
_KIND[ord("\n")] = 7


def _kinds(text: bytes) -> np.ndarray:
    """Bytes of each kind."""
    raw = np.frombuffer(text, dtype=np.uint8)
    return sum((np.bincount(_KIND[raw[at : at + PORTION]], minlength=8) for at in range(0, len(raw), PORTION)), np.zeros(8, dtype=np.int64))


def measures(rows: list[bytes]) -> np.ndarray:
    """A row of MEASURES for each text. Words are compared without case; shares of nothing are 0."""
    hashes, begins = word_hashes(rows)
    found = np.zeros((len(rows), len(MEASURES)))
    for i, text in enumerate(rows):
        own, kinds = hashes[begins[i] : begins[i + 1]], _kinds(text)
        n, size = max(len(own), 1), max(len(text), 1)
        often = np.unique(own, return_counts=True)[1]
        pairs = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])
        found[i] = (
            np.log2(1 + len(own)), len(often) / n, len(np.unique(pairs)) / max(len(pairs), 1), np.count_nonzero(own[1:] == own[:-1]) / n, often.max(initial=0) / n,
            kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, (len(text) - kinds[6] - kinds[7]) / n, np.log2(1 + len(own) / (1 + kinds[7])),
        )
    return found


class Model(NamedTuple):
    """Cuts and tables: a bin is the number of cuts below a value; a pair's bins are those of its own, coarser cuts."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, f], side="left")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="left"), np.searchsorted(self.coarse[j], x[:, j], side="left")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 values of the sample, at quantiles; a value that equals a cut lies below it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower")) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, k) of the cut of bins into the first k and the rest that explains most; sides weigh LEAST at least."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain = np.where((left_h >= LEAST / 4) & (h.sum() - left_h >= LEAST / 4), gain, 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of depth two over ordered bins with gradients g and weights h."""
    edges = {0, len(g)}
    for _ in range(2):
        ends = sorted(edges)
        for a, b in zip(ends, ends[1:], strict=False):
            gain, at = best_cut(g[a:b], h[a:b])
            if gain > 1e-9:
                edges.add(a + at)
    ends = sorted(edges)
    return np.concatenate([np.full(b - a, RATE * g[a:b].sum() / (h[a:b].sum() + SHRINK)) for a, b in zip(ends, ends[1:], strict=False)])


def best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, a, b) of the two cuts, at row a and column b, whose four quarters explain most."""
    if min(g.shape) < 2:
        return 0.0, 0, 0
    sums = [x.cumsum(0).cumsum(1) for x in (g, h)]
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    for quarter in (lambda s: s[:-1, :-1], lambda s: s[:-1, -1:] - s[:-1, :-1], lambda s: s[-1:, :-1] - s[:-1, :-1], lambda s: s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1]):
        gain = gain + _gain(quarter(sums[0]), quarter(sums[1]))
    gain = gain - _gain(g.sum(), h.sum())
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[a, b]), int(a) + 1, int(b) + 1


def fit(x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pairs: int = PAIRS) -> Model:
    """The model that rows of measures and their labels (0 or 1) teach; without rows, all scores are 0.5."""
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    cuts, coarse = ([_cuts(x[:, f], n) for f in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    at = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(coarse)]
    total = np.full(len(y), bias)

    def slopes(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)

    for _ in range(cycles):
        for f, values in enumerate(tables):
            step = tree(*slopes(at[f], len(values)))
            values += step
            total += step[at[f]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = rough[i] * shape[1] + rough[j]
        g, h = slopes(cell, shape[0] * shape[1])
        return g.reshape(shape), h.reshape(shape), cell

    ranked = sorted(((-best_cross(*grid(i, j)[:2])[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked[:pairs] if gain < -1e-9]
    for _ in range(PAIR_CYCLES):
        for i, j, values in chosen:
            g, h, cell = grid(i, j)
            _, a, b = best_cross(g, h)
            step = np.zeros_like(g)
            for part in ((slice(a), slice(b)), (slice(a), slice(b, None)), (slice(a, None), slice(b)), (slice(a, None), slice(b, None))):
                step[part] = RATE * g[part].sum() / (h[part].sum() + SHRINK)
            values += step
            total += step.ravel()[cell]
    for values in (*tables, *(v for _, _, v in chosen)):  # means go to the bias, so that tables say how a bin differs
        bias += float(values.mean())
        values -= values.mean()
    return Model(bias, cuts, tables, coarse, chosen)


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns, and x: the measures of each row's whole text."""
    rows = texts(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, PORTION):
                x = pa.FixedSizeListArray.from_arrays(pa.array(measures(part.column("text").to_pylist()).ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *more)), x], ["doc_id", *more, "x"])

    kept = rows.select("doc_id", *more).schema
    return rows.mapInArrow(lean(run), kept.add("x", ArrayType(DoubleType())))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model that labelled texts teach. docs: doc_id, text; labels: doc_id, quality (rows with a null in either teach nothing).

    At most `sample` labelled documents, those whose doc_id hashes lowest, teach: their measures, 100 bytes each, go to the
    driver. A doc_id that is labelled several times is good where one label says so; of several texts with one doc_id the one with
    the smallest measures teaches. Nothing else depends on the size of the corpus.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(sample)
    rows = _measured(docs.join(F.broadcast(chosen.select("doc_id", F.col("quality").alias("quality_"), F.col("turn").alias("turn_"))), "doc_id"), "quality_", "turn_")  # `sample` rows at most
    found = rows.groupBy("turn_", "doc_id", "quality_").agg(F.min("x").alias("x")).orderBy("turn_", "doc_id").select("quality_", "x").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(MEASURES))
    return fit(x, found["quality_"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) for each row of docs.

    Every row is scored on its whole text, a null one as an empty text. Repeated rows repeat in the result; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, PORTION):
                scores = shared.value.score(measures(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def fold() -> F.Column:
    """crc32 of doc_id as text, mod 5: 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(fold() != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
