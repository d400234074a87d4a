"""Approximate nearest neighbours over balanced posting lists.

Vectors are dealt into bands by length, a factor of two each, so that a few long ones don't make all others look
alike. Within a band, one more coordinate gives all vectors the same length, and the largest inner product becomes the
smallest distance. A band's centroids are fitted in two levels on a bounded sample (a few on the driver, then those of each
of their cells in a task), with a charge on full clusters that keeps lists even; their number grows with the
rows, up to CENTROIDS. A graph of their neighbours, held in memory, is searched best first, or, where that would
see most centroids, all are compared at once. Every row is indexed: it goes to its nearest centroid and, near a boundary, to one
more. A query reads the lists whose centroid distance is within a ratio of its nearest, and no band whose longest vector can't reach
the k-th score of the longest vectors of all. Lists are dealt out by regions of consecutive lists; a query goes once to each region that it reads,
with the k-th score among SEEDS rows, which are candidates too: what lies below it is dropped by a product in single precision with a margin,
and the rest is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import lean, stage, table
from inkflow.llm.topk import by_dimension, matrix, usable

K, EVERY = 20, 20
#: Rows that the first level is fitted on at most (smallest hash of vec_id), centroids of a band at most, vectors for each,
#: and rows for each that the second level is fitted on.
SAMPLE, CENTROIDS, PER_CENTROID, PER_FIT = 4096, 16_384, 20, 40
#: Bands of length; the last one holds all shorter vectors too. Longest vectors that rule bands out.
BANDS, LONGEST = 16, 1024
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Lists that a vector goes to at most, and how much farther (as a ratio) than its nearest they may be.
REPLICAS, BOUNDARY = 2, 1.25
#: How much farther than its nearest a list that a query reads may be; lists that it reads at most are
#: REACH times the square root of all, and LEAST_PROBES in any case.
RATIO, REACH, LEAST_PROBES = 1.4, 12.0, 24
#: Vectors of a region, about, beyond which it is split; regions at least; candidates that a task holds before it drops all but the best, and queries that it holds them for.
REGION, REGIONS, HELD, QUERIES = 1 << 18, 24, 1 << 19, 20_000
#: Rows of each length that every query meets, at most (an eighth of all, if that is less).
SEEDS = 1 << 16


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def fit(x: np.ndarray, k: int, rounds: int = 10, charge: float = 0.5, seed: int = 7) -> np.ndarray:
    """At most k balanced centroids, of length 1 as the rows of x are: distance plus a charge for members beyond the mean."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    spread = max(float(x.var(0).sum()), 1e-12)
    load = np.zeros(k)
    for _ in range(rounds):
        cost = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T + charge * spread * np.maximum(load * k / len(x) - 1, 0)[None, :]
        own = cost.argmin(1)
        n = np.bincount(own, minlength=k)
        load = 0.5 * load + 0.5 * n
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        length = _lengths(sums)[:, None]
        centroids = np.where((n[:, None] > 0) & (length > 1e-9), sums / np.maximum(length, 1e-9), x[rng.choice(len(x), k)])
    return centroids


class Graph:
    """Centroids, each linked to its DEGREE nearest, some that it is near to, and the next one; searched best first."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        self.norms = (self.c**2).sum(1)
        k = len(self.c)
        near = np.zeros((k, min(DEGREE, k - 1)), dtype=np.int32)
        for at in range(0, k, 512):
            d = self.norms[None, :] - 2 * self.c[at : at + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 512] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[at : at + 512]
        back: list[list[int]] = [[] for _ in range(k)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < DEGREE:
                    back[j].append(i)
        # The next one keeps the graph connected; rows are filled up with the node itself.
        self.links = np.tile(np.arange(k, dtype=np.int32)[:, None], 2 * DEGREE + 1)
        for i in range(k):
            to = sorted({*near[i].tolist(), *back[i], (i + 1) % k})
            self.links[i, : len(to)] = to
        self.entry = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int32))

    def search(self, x: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x: the nearest centroids found (at most `kept`, then -1), nearest first, and squared distances."""
        kept = min(kept, len(self.c))
        one = self._search if 4 * kept * DEGREE < len(self.c) else self._all
        found = [one(x[at : at + 256].astype(np.float32), kept) for at in range(0, len(x), 256)]
        return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros((0, 1), dtype=np.int32), np.zeros((0, 1)))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] + self.norms[None, :] - 2 * (x @ self.c.T)

    def _all(self, x: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(x)
        nodes = np.argpartition(d, kept - 1, axis=1)[:, :kept]
        d = np.take_along_axis(d, nodes, 1)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1).astype(np.int32), np.maximum(np.take_along_axis(d, order, 1), 0).astype(np.float64)

    def first(self, x: np.ndarray, kept: int, width: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """As search, for a few of many centroids: the nearest lie among the `kept` of groups of `width` whose nearest is nearest."""
        k = len(self.c)
        if k <= 4 * width * kept:
            found = [self._all(x[at : at + 256].astype(np.float32), min(kept, k)) for at in range(0, len(x), 256)]
            return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros((0, 1), dtype=np.int32), np.zeros((0, 1)))
        nodes, far = [], []
        for at in range(0, len(x), 256):
            d = self._distances(x[at : at + 256].astype(np.float32))
            d = np.concatenate((d, np.full((len(d), -k % width), np.inf, dtype=np.float32)), axis=1).reshape(len(d), -1, width)
            groups = np.argpartition(d.min(2), kept - 1, axis=1)[:, :kept]
            near = np.take_along_axis(d, groups[:, :, None], 1).reshape(len(d), -1)
            order = np.argpartition(near, kept - 1, axis=1)[:, :kept]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(near, order, 1), axis=1, kind="stable"), 1)
            nodes.append((np.take_along_axis(groups, order // width, 1) * width + order % width).astype(np.int32))
            far.append(np.maximum(np.take_along_axis(near, order, 1), 0).astype(np.float64))
        return (np.concatenate(nodes), np.concatenate(far)) if nodes else (np.zeros((0, 1), dtype=np.int32), np.zeros((0, 1)))

    def _search(self, x: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows, norms = len(x), np.arange(len(x)), (x**2).sum(1)
        seen = np.zeros((n, len(self.c)), dtype=bool)
        at_once = max(1, min(8, kept // 4))
        nodes = np.full((n, kept), -1, dtype=np.int32)
        d = np.full((n, kept), np.inf, dtype=np.float32)
        done = np.zeros((n, kept), dtype=bool)

        def take(live: np.ndarray, to: np.ndarray) -> None:
            """Puts new nodes among the best found; those that were seen have no distance."""
            to = np.sort(to, axis=1)
            new = ~seen[live[:, None], to]
            new[:, 1:] &= to[:, 1:] != to[:, :-1]
            seen[live[:, None], to] = True
            far = norms[live, None] + self.norms[to] - 2 * np.matmul(self.c[to], x[live, :, None])[:, :, 0]
            all_d = np.concatenate((d[live], np.where(new, far, np.inf)), axis=1)
            order = np.argpartition(all_d, kept - 1, axis=1)[:, :kept]
            d[live] = np.take_along_axis(all_d, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate((nodes[live], to), axis=1), order, 1)
            done[live] = np.take_along_axis(np.concatenate((done[live], np.zeros(to.shape, dtype=bool)), axis=1), order, 1)

        take(rows, np.tile(self.entry, (n, 1)))
        live = rows
        while len(live):
            waiting = np.where(done[live], np.inf, d[live])
            live = live[np.isfinite(waiting.min(1))]
            if not len(live):
                break
            waiting = np.where(done[live], np.inf, d[live])
            place = np.argpartition(waiting, at_once - 1, axis=1)[:, :at_once]
            open_ = np.isfinite(np.take_along_axis(waiting, place, 1))
            place = np.where(open_, place, waiting.argmin(1)[:, None])
            done[live[:, None], place] = True
            take(live, self.links[nodes[live[:, None], place]].reshape(len(live), -1))
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        return np.where(np.isfinite(d), np.take_along_axis(nodes, order, 1), -1), np.maximum(d, 0).astype(np.float64)


def lists_of(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): where each row of x is stored."""
    order, d = graph.first(x, REPLICAS)
    rows, places = np.nonzero(d <= BOUNDARY**2 * d[:, :1] + 1e-12)
    return rows, order[rows, places]


def probes(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): which lists each row of x reads."""
    most = int(max(LEAST_PROBES, REACH * np.sqrt(len(graph.c))))
    order, d = graph.search(x, most)
    rows, column = np.nonzero((order >= 0) & ((d <= RATIO**2 * d[:, :1] + 1e-12) | (np.arange(order.shape[1]) < LEAST_PROBES)[None, :]))
    return rows, order[rows, column]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x over `most`, with one more coordinate, so that all rows have the length 1."""
    x = x / most
    return np.column_stack((x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products; equal rows give equal sums wherever they stand."""
    return (a * b).sum(1)


def best_of(query: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best candidates, by query, then best first, ties to the smaller id; a row counts once."""
    order = np.lexsort((row, ids, -scores, query))
    again = np.zeros(len(order), dtype=bool)
    # Equal rows of one query have equal ids and scores, so they stand together.
    again[1:] = (query[order][1:] == query[order][:-1]) & (row[order][1:] == row[order][:-1])
    order = order[~again]
    first = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1])) if len(order) else np.zeros(0, dtype=int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def _fitted(good: DataFrame, spaces: dict[tuple[int, int], tuple[int, float]]) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of each space (dim, band), whose rows and greatest length are given."""
    spark = good.sparkSession
    counts = {space: int(min(CENTROIDS, max(1, n // PER_CENTROID))) for space, (n, _) in spaces.items()}
    turn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    coarse: dict[tuple[int, int], np.ndarray] = {}
    for (dim, band), (n, most) in spaces.items():
        share = min(1 << 20, -(-(SAMPLE * 5 // 4) * (1 << 20) // n))
        sample = good.filter((F.size("embedding") == dim) & (F.col("band") == band) & (turn < share)).orderBy(turn, "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        if not len(sample):  # no hash is that small
            sample = good.filter((F.size("embedding") == dim) & (F.col("band") == band)).limit(1).select("embedding").toPandas()["embedding"]
        coarse[dim, band] = fit(lifted(np.stack(sample.to_numpy()).astype(np.float64), most), int(np.ceil(np.sqrt(counts[dim, band]))))
    shared = spark.sparkContext.broadcast((coarse, spaces, counts))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, spaces, _ = shared.value
        for batch in batches:
            for space, part in by_space(batch):
                x, c = lifted(matrix(part.column("embedding")), spaces[space][1]), coarse[space]
                own = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), v, dtype=np.int32)) for v in space] + [pa.array(own.astype(np.int32)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["dim", "band", "cell", "x"])

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        _, spaces, counts = shared.value
        dim, band, cell = (int(rows[c].iloc[0]) for c in ("dim", "band", "cell"))
        n = max(1, round(len(rows) / min(1.0, PER_FIT * counts[dim, band] / spaces[dim, band][0]) * counts[dim, band] / spaces[dim, band][0]))
        found = fit(np.stack(rows["x"].to_numpy()).astype(np.float64), n)
        return pd.DataFrame({"dim": np.int32(dim), "band": np.int32(band), "cell": np.int32(cell), "c": list(found.astype(np.float32))})

    drawn = F.lit(False)
    for (dim, band), (n, _) in spaces.items():
        drawn |= (F.size("embedding") == dim) & (F.col("band") == band) & (turn < int(min(1.0, PER_FIT * counts[dim, band] / n) * (1 << 20)))
    celled = good.filter(drawn).select("embedding", "band").mapInArrow(lean(cells), "dim int, band int, cell int, x array<float>")
    rows = celled.groupBy("dim", "band", "cell").applyInPandas(centroids, "dim int, band int, cell int, c array<float>").toPandas()  # CENTROIDS, about, for each space
    found = {}
    for space in spaces:
        own = rows[(rows["dim"] == space[0]) & (rows["band"] == space[1])].sort_values("cell", kind="stable")
        found[space] = np.unique(np.stack(own["c"].to_numpy()), axis=0) if len(own) else coarse[space]
    return found


def by_space(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    for dim, part in by_dimension(batch):
        bands = part.column("band").to_numpy()
        for band in np.unique(bands):
            yield (dim, int(band)), part.filter(pa.array(bands == band))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found with the largest inner products, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding. Rows that are null, zero, or hold null or non-finite components
    take no part; a query doesn't meet rows of its own vec_id, nor vectors of another length. With
    fewer than 2 * PER_CENTROID vectors there is one list, which is read in full. Rows that repeat are candidates, and
    queries, of their own.
    """
    spark = vectors.sparkSession
    nonzero = F.exists("embedding", lambda x: x != 0)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # Sums may overflow or vanish where components don't; such rows meet the others in the first or last band.
    good = usable(vectors).filter(nonzero).withColumn("dim", F.size("embedding")).withColumn("length", F.greatest(F.least(length, F.lit(1e150)), F.lit(1e-150)))
    most_of = {r["dim"]: r["most"] for r in good.groupBy("dim").agg(F.max("length").alias("most")).collect()}  # a row for each length of vectors
    if not most_of:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = F.element_at(F.create_map(*[F.lit(x) for pair in most_of.items() for x in pair]), F.col("dim"))
    good = good.withColumn("band", F.least(F.lit(BANDS - 1), F.floor(F.log2(top / F.col("length")))).cast("int"))
    spaces = {(r["dim"], r["band"]): (r["n"], r["most"]) for r in good.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("length").alias("most")).collect()}
    graphs = {space: (Graph(c), spaces[space][1]) for space, c in _fitted(good, spaces).items()}
    longest: dict[int, list] = {dim: [] for dim in most_of}
    for dim in most_of:  # only where there is more than one band
        if sum(d == dim for d, _ in spaces) > 1:
            rows = good.filter(F.col("dim") == dim).orderBy(F.desc("length"), "vec_id").limit(LONGEST).select("vec_id", "embedding").toPandas()
            longest[dim] = [rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)]
    across = {space: -(-len(g.c) // max(min(REGIONS, len(g.c)), -(-spaces[space][0] * REPLICAS // REGION))) for space, (g, _) in graphs.items()}  # lists of a region
    kind = dict(good.dtypes)["embedding"]
    # Single precision holds products of such vectors with an error below the margin.
    single = kind == "array<float>" and all(1e-9 < most < 1e9 for _, most in spaces.values())
    dtype, margin = (np.float32, 1e-5) if single else (np.float64, 1e-9)
    shared = spark.sparkContext.broadcast((graphs, longest))  # CENTROIDS and LONGEST vectors for each space

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, part in by_space(batch):
                graph, most = shared.value[0][space]
                rows, lists = lists_of(graph, lifted(matrix(part.column("embedding")), most))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(rows), v, dtype=np.int32)) for v in space), pa.array((lists // across[space]).astype(np.int32)), pa.array(lists.astype(np.int32)), part.column("row").take(at), part.column("vec_id").cast(pa.int64()).take(at), part.column("embedding").take(at)], ["dim", "band", "region", "list", "row", "vec_id", "embedding"])

    key = ["dim", "band", "region"]
    postings = stage(good.select("vec_id", "embedding", "band").withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(index), f"dim int, band int, region int, list int, row long, vec_id long, embedding {kind}"))
    turn, drawn, few = F.pmod(F.xxhash64("row"), F.lit(1 << 20)), F.lit(False), {dim: sum(n for (d, _), (n, _) in spaces.items() if d == dim) for dim in most_of}
    for dim, n in few.items():
        drawn |= (F.col("dim") == dim) & (turn < -(-min(SEEDS, n // 8) * (1 << 20) // n))
    seeds = {dim: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, dim), dtype=dtype)) for dim in most_of}
    sample = postings.filter(drawn).select("dim", "row", "vec_id", "embedding").dropDuplicates(["row"]).toPandas()  # SEEDS rows of each length, about
    for dim, own in sample.groupby("dim"):
        own = own.sort_values("row")
        seeds[int(dim)] = (own["row"].to_numpy(), own["vec_id"].to_numpy(), np.stack(own["embedding"].to_numpy()).astype(dtype))
    planted = spark.sparkContext.broadcast(seeds)

    def met(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query's seeds the best by a product: places of queries and seeds, and scores; not those of its own id."""
        _, own_ids, own = planted.value[x.shape[1]]
        # A seed of the query's own id may take a place each time that it occurs.
        most = min(len(own), k + (int(np.unique(own_ids, return_counts=True)[1].max()) if len(own) else 0))
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for at in range(0, len(x) if most else 0, 256):
            scores = x[at : at + 256].astype(dtype) @ own.T
            best = np.argpartition(scores, -most, axis=1)[:, -most:]
            found.append((at + np.repeat(np.arange(len(best)), most), best.ravel()))
        i, j = (np.concatenate(f) for f in zip(*found, strict=True))
        other = ids[i] != own_ids[j]
        i, j = i[other], j[other]
        return i, j, dots(own[j].astype(np.float64), x[i])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dimension(batch):
                rows, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
                i, j, scores = met(matrix(part.column("embedding")), ids)
                yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(ids[i]), pa.array(planted.value[dim][0][j]), pa.array(planted.value[dim][1][j]), pa.array(scores)], ["query", "query_id", "row", "vec_id", "score"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, longest = shared.value
        for batch in batches:
            for dim, part in by_dimension(batch):
                x, ids = matrix(part.column("embedding")), part.column("vec_id").to_numpy()
                lengths = np.maximum(_lengths(x), 1e-150)
                floor = np.full(len(x), -np.inf)
                i, _, scores = met(x, ids)
                order = np.lexsort((-scores, i))
                first = np.searchsorted(i, np.arange(len(x) + 1))
                full = np.flatnonzero(np.diff(first) >= k)
                floor[full] = scores[order][first[:-1][full] + k - 1]
                least = floor.copy()
                if len(own := longest.get(dim, ())) and len(own[0]) > k:
                    scores = np.where(ids[:, None] == own[0][None, :], -np.inf, x @ own[1].T)
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                for space in (s for s in graphs if s[0] == dim):
                    graph, most = graphs[space]
                    live = np.flatnonzero(lengths * most * (1 + 1e-9) >= least)
                    rows, lists = probes(graph, np.column_stack((x[live] / lengths[live, None], np.zeros(len(live)))))
                    regions = lists // across[space]
                    order = np.lexsort((lists, regions, rows))
                    rows, lists, regions = live[rows[order]], lists[order], regions[order]
                    starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (regions[1:] != regions[:-1]))) if len(rows) else np.zeros(0, dtype=int)
                    at = pa.array(rows[starts])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.full(len(starts), v, dtype=np.int32)) for v in space), pa.array(regions[starts].astype(np.int32)), part.column("row").take(at), part.column("vec_id").cast(pa.int64()).take(at), part.column("embedding").take(at), pa.array(floor[rows[starts]]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(lists)).astype(np.int32)), pa.array(lists.astype(np.int32)))],
                        ["dim", "band", "region", "row", "vec_id", "embedding", "floor", "lists"],
                    )

    sizes = postings.groupBy(*key).agg(F.ceil(F.count("*") / REGION).cast("int").alias("subs"))  # CENTROIDS rows for each space, at most
    stored = postings.join(F.broadcast(sizes), key).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    asked = stage(usable(queries).filter(nonzero).select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()))
    reads = asked.mapInArrow(lean(probe), f"dim int, band int, region int, row long, vec_id long, embedding {kind}, floor double, lists array<int>").join(F.broadcast(sizes), key).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    columns = [*key, "sub", "kind", "list", "row", "vec_id", "embedding", "floor", "lists"]
    together = stored.withColumns({"kind": F.lit(0), "floor": F.lit(None).cast("double"), "lists": F.lit(None).cast("array<int>")}).select(*columns).unionByName(reads.withColumns({"kind": F.lit(1), "list": F.lit(0)}).select(*columns))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A region's vectors, by list, come before the queries that read it. Candidates are held until they are too many, then only each query's best."""
        own_key, parts, region = None, [], None
        number: dict[int, int] = {}  # of the task's queries, by row
        least, query_ids, query_rows = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        size, bound = 0, HELD

        def prune() -> None:
            nonlocal size, bound
            query, row, vec, score = (np.concatenate(c) for c in zip(*held, strict=True))
            at = best_of(query, row, vec, score, k)
            query, score = query[at], score[at]
            held[:] = [(query, row[at], vec[at], score)]
            size = len(at)
            bound = max(HELD, 2 * size)  # the best of many queries alone may be HELD
            ends = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if size else np.zeros(0, dtype=int)
            full = ends[np.diff(np.append(-1, ends)) == k]
            least[query[full]] = np.maximum(least[query[full]], score[full])

        def answer(part: pa.RecordBatch, most: float) -> None:
            nonlocal least, query_ids, query_rows, size
            q_rows, q_ids, q = part.column("row").to_numpy(), part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
            fresh = [i for i, r in enumerate(q_rows.tolist()) if r not in number]
            number.update(zip(q_rows[fresh].tolist(), range(len(least), len(least) + len(fresh)), strict=True))
            query_ids, query_rows = np.append(query_ids, q_ids[fresh]), np.append(query_rows, q_rows[fresh])
            least = np.append(least, part.column("floor").to_numpy()[fresh])
            at = np.array([number[r] for r in q_rows.tolist()])
            floor = least[at] - margin * _lengths(q) * most
            floor = np.where(np.isfinite(floor), floor, -np.inf).astype(dtype)
            own_lists, own_ids, own_rows, own = region
            narrow = q.astype(dtype)
            lists = part.column("lists")
            read, which = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.array(lists.value_lengths()))
            order = np.argsort(read, kind="stable")
            read, which = read[order], which[order]
            distinct, starts = np.unique(read, return_index=True)
            begins, ends = np.searchsorted(own_lists, distinct), np.searchsorted(own_lists, distinct, side="right")
            for start, stop, begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(read)], begins.tolist(), ends.tolist(), strict=True):
                if begin == end:
                    continue
                asks = which[start:stop]
                for low in range(0, len(asks), 256):
                    few = asks[low : low + 256]
                    i, j = np.divmod(np.flatnonzero(narrow[few] @ own[begin:end].T >= floor[few, None]), end - begin)
                    i, j = few[i], j + begin
                    other = q_ids[i] != own_ids[j]
                    if other.any():
                        i, j = i[other], j[other]
                        held.append((at[i], own_rows[j], own_ids[j], dots(own[j].astype(np.float64), q[i])))
                        size += len(i)
                        if size > bound:
                            prune()

        def found() -> pa.RecordBatch:
            prune()
            query, row, vec, score = held[0]
            return pa.RecordBatch.from_arrays([pa.array(query_rows[query]), pa.array(query_ids[query]), pa.array(row), pa.array(vec), pa.array(score)], ["query", "query_id", "row", "vec_id", "score"])

        for batch in batches:
            head = np.column_stack([batch.column(c).to_numpy() for c in (*key, "sub", "kind")])
            cuts = np.append(np.flatnonzero(np.append(True, (head[1:] != head[:-1]).any(1))), len(head)) if len(head) else [0]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, stop - start)
                if tuple(head[start, :4]) != own_key:
                    own_key, parts, region = tuple(head[start, :4]), [], None
                if head[start, 4] == 0:
                    parts.append((part.column("list").to_numpy(), part.column("vec_id").to_numpy(), part.column("row").to_numpy(), matrix(part.column("embedding")).astype(dtype)))
                elif parts or region:
                    if parts:
                        region = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                        parts = []
                    answer(part, spaces[int(head[start, 0]), int(head[start, 1])][1])
                if len(number) > QUERIES:
                    if held:
                        yield found()
                    held, size, bound = [], 0, HELD
                    number.clear()
                    least, query_ids, query_rows = least[:0], query_ids[:0], query_rows[:0]
        if held:
            yield found()

    pairs = "query long, query_id long, row long, vec_id long, score double"
    partial = together.repartition(*key, "sub").sortWithinPartitions(*key, "sub", "kind", "list").mapInArrow(lean(search), pairs).unionByName(asked.mapInArrow(lean(seeded), pairs))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial answers come sorted by query; a batch's last query waits for the next batch."""
        rest = None
        for batch in batches:
            rest = pa.concat_batches([rest, batch]) if rest is not None else batch
            query = rest.column("query").to_numpy()
            if len(query) and query[0] != query[-1]:
                cut = int(np.searchsorted(query, query[-1]))
                yield ranked(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield ranked(rest)

    def ranked(part: pa.RecordBatch) -> pa.RecordBatch:
        query, row, vec, score = (part.column(c).to_numpy() for c in ("query", "row", "vec_id", "score"))
        at = best_of(query, row, vec, score, k)
        first = np.flatnonzero(np.append(True, query[at][1:] != query[at][:-1])) if len(at) else np.zeros(0, dtype=int)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
        return pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(vec[at]), pa.array(score[at])], ["query_id", "rank", "vec_id", "score"])

    return partial.repartition("query").sortWithinPartitions("query").mapInArrow(lean(rank), "query_id long, rank int, vec_id long, score double")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
