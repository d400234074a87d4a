"""Exact top-k by inner product over integer vectors.

Candidates are dealt out once by descending length, into runs of bounded size. The longest of all give each query a
first k-th score, and a block of queries goes only to runs whose longest vector can reach that score of one of its
queries. A task holds a run and takes the blocks of queries one after another: blocks of candidates are met longest
first; a block whose longest vector cannot reach a query's k-th score is left out; within a block, sums over the first
coordinates of an SVD rotation plus the product of the residual lengths bound every score, and only pairs that may enter
are computed in full. So each candidate is shuffled twice, whatever the number of queries, and a query once for each run that it may need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import lean, stage, table

K, EVERY, SCALE = 10, 100, 1024
#: Vectors of a candidate block, queries of a query block, coordinates of the partial sums.
BLOCK, QUERIES, HEAD = 2048, 1024, 16
#: Candidates of a run, which one task holds, about, and runs at most (beyond that they grow).
RUN, RUNS = 32_768, 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: no null, nothing null or non-finite inside, a vec_id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); what doesn't fit a long becomes the nearest long."""
    return np.clip(np.floor(x * scale), -(2.0**63) + 1024, 2.0**63 - 1024).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly; sums that don't fit a long become the nearest long."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def _rotations(vectors: DataFrame, scale: int) -> dict[int, np.ndarray]:
    """By dimension: the right singular vectors of all its vectors, largest first, from sums of products."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in by_dimension(batch):
                x = integers(matrix(rows.column("embedding")), scale).astype(np.float64)
                sums[dim] = sums.get(dim, 0.0) + x.T @ x
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, dtype=np.int32)), pa.array(np.arange(m.size, dtype=np.int64)), pa.array(m.reshape(-1))], ["dim", "cell", "x"])

    rows = vectors.mapInArrow(lean(moments), "dim int, cell long, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x")).toPandas()
    found = {}
    for dim, cells in rows.groupby("dim"):
        m = np.zeros(int(dim) ** 2)
        m[cells["cell"].to_numpy()] = cells["x"].to_numpy()
        found[int(dim)] = np.linalg.eigh(m.reshape(int(dim), int(dim)))[1][:, ::-1]
    return found


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.asarray(batch.column("embedding").value_lengths())
    for dim in np.unique(lengths):
        yield int(dim), batch.filter(pa.array(lengths == dim))


def narrow(x: np.ndarray) -> np.ndarray:
    """x as 32-bit numbers where they fit."""
    return x.astype(np.int32) if not x.size or max(-int(x.min()), int(x.max())) < 1 << 31 else x


def widened(x: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int32 if len(x) == 4 * n * dim else np.int64).reshape(n, dim).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, whole numbers) of rows in their order, `size` to a block."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def full(dim: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, x = (np.concatenate(parts) for parts in zip(*kept[dim], strict=True))
        while len(ids) >= least:
            yield dim, ids[:size], x[:size]
            ids, x = ids[size:], x[size:]
        kept[dim] = [(ids, x)]

    for batch in batches:
        for dim, rows in by_dimension(batch):
            kept.setdefault(dim, []).append((rows.column("vec_id").cast(pa.int64()).to_numpy(), integers(matrix(rows.column("embedding")), scale)))
            yield from full(dim, size)
    for dim in kept:
        yield from full(dim, 1)


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _runs(sorted_: DataFrame, size: int, scale: int) -> DataFrame:
    """A partition of rows in their order as blocks: run (the partition), dim, most (the largest length), n, ids and whole numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for dim, ids, x in _blocks(batches, size, scale):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([dim], pa.int32()), pa.array([float(_length(x).max())]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrow(x).tobytes()], pa.binary())], ["run", "dim", "most", "n", "ids", "x"])

    return sorted_.select("vec_id", "embedding").mapInArrow(lean(run), "run int, dim int, most double, n int, ids binary, x binary")


class Best:
    """The k best candidates of each query of a block, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, dtype=np.int64)] * queries, [np.zeros(0, dtype=np.int64)] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[i], scores)), np.concatenate((self.ids[i], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[i] = self.scores[i][-1]


class Candidates:
    """A block of candidates with what bounds their scores."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        self.ids, self.x = ids, x
        rotated = x.astype(np.float64) @ rotation
        head = min(HEAD, x.shape[1])
        self.head, self.rest, self.longest = rotated[:, :head].copy(), np.sqrt((rotated[:, head:] ** 2).sum(1)), np.sqrt((rotated**2).sum(1)).max()

    def enter(self, best: Best, q_ids: np.ndarray, q: np.ndarray, head: np.ndarray, rest: np.ndarray, lengths: np.ndarray) -> None:
        """Takes these candidates into the best of a block of queries (numbers, rotated heads, lengths of the rest and of all)."""
        live = np.flatnonzero(lengths * self.longest * (1 + 1e-9) + 1 >= best.least)
        if not len(live):
            return
        bound = head[live] @ self.head.T + np.outer(rest[live], self.rest)
        may = bound + np.abs(bound) * 1e-9 + 1 >= best.least[live][:, None]
        may &= q_ids[live][:, None] != self.ids[None, :]
        columns, rows = np.flatnonzero(may.any(0)), np.flatnonzero(may.any(1))
        if not len(rows):
            return
        full = products(q[live[rows]], self.x[columns])
        for row, r in enumerate(rows):
            i = live[r]
            good = np.flatnonzero(may[r, columns] & (full[row] >= best.least[i]))
            if len(good):
                best.add(i, full[row, good], self.ids[columns[good]])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES, run: int = RUN) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding. Rows that don't take part are left out (see usable);
    vectors of different lengths don't meet. A query doesn't meet rows of its own vec_id; rows that
    repeat otherwise are candidates (and queries) of their own.
    """
    spark = vectors.sparkSession
    good, asked = usable(vectors), usable(queries)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ordered = good.withColumn("length", -length).withColumn("row", F.monotonically_increasing_id())
    rotations = _rotations(good, scale)
    # Runs are no larger than keeps all cores busy, and no smaller than a block.
    count = good.count()
    run = max(block, min(run, -(-count // spark.sparkContext.defaultParallelism)), -(-count // RUNS))
    candidates = stage(_runs(ordered.repartitionByRange(max(1, -(-count // run)), "length", "vec_id", "row").sortWithinPartitions("length", "vec_id", "row"), block, scale))
    first = {}
    for dim in rotations:  # `block` vectors of each dimension: the longest
        rows = candidates.filter(F.col("dim") == dim).orderBy(F.desc("most"), "run").limit(1).collect()
        first[dim] = [(np.frombuffer(r["ids"], dtype=np.int64), widened(r["x"], r["n"], dim)) for r in rows]
    shared = spark.sparkContext.broadcast((rotations, first))  # a matrix and a block for each dimension

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries: least (what a score must reach to be among the best), need (the length from which a candidate may reach one of these)."""
        rotations, first = shared.value
        for dim, ids, x in _blocks(batches, query_block, scale):
            best, lengths = Best(len(ids), k), _length(x)
            if dim in rotations:
                rotated, head = x.astype(np.float64) @ rotations[dim], min(HEAD, dim)
                for own in first[dim]:
                    Candidates(*own, rotations[dim]).enter(best, ids, x, rotated[:, :head], np.sqrt((rotated[:, head:] ** 2).sum(1)), lengths)
            need = ((best.least - 1) / np.maximum(lengths, 1e-300) * (1 - 1e-9)).min()
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([float(need)]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrow(x).tobytes()], pa.binary()), pa.array([best.least.tobytes()], pa.binary())], ["dim", "need", "n", "ids", "x", "least"])

    parts = max(1, -(-count // (block * 8 * EVERY)))
    asked_blocks = stage(asked.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(lean(ask), "dim int, need double, n int, ids binary, x binary, least binary").withColumn("q", F.monotonically_increasing_id()))
    reach = candidates.groupBy("run", "dim").agg(F.max("most").alias("most"))  # RUNS rows at most for each dimension
    heads = asked_blocks.join(F.broadcast(reach), "dim").filter("most >= need").withColumn("kind", F.lit(1))
    held = candidates.withColumns({"kind": F.lit(0), "q": F.lit(-1).cast("long"), "least": F.lit(None).cast("binary")})
    columns = ["run", "dim", "kind", "q", "most", "n", "ids", "x", "least"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, _ = shared.value
        key, own = None, []
        for batch in batches:
            for run_, dim, kind, q, _, n, ids, x, least in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if key != (run_, dim):
                    key, own = (run_, dim), []
                ids, x = np.frombuffer(ids, dtype=np.int64), widened(x, n, dim)
                if not kind:
                    own.append(Candidates(ids, x, rotations[dim]))
                    continue
                best, lengths = Best(n, k), _length(x)
                best.least = np.frombuffer(least, dtype=np.float64).copy()
                rotated, head = x.astype(np.float64) @ rotations[dim], min(HEAD, dim)
                for block_ in own:
                    block_.enter(best, ids, x, rotated[:, :head], np.sqrt((rotated[:, head:] ** 2).sum(1)), lengths)
                sizes = [len(s) for s in best.scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(np.arange(n), sizes).astype(np.int64) + q * query_block), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "row", "vec_id", "score"])

    together = held.select(*columns).unionByName(heads.select(*columns)).repartition("run", "dim").sortWithinPartitions("run", "dim", "kind", F.desc("most"))
    partial = together.mapInArrow(lean(meet), "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
