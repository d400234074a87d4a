"""What the corpus operators share: tables, staging on the shared folder, word hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow import staging


#: Rows and bytes of an Arrow batch, which the JVM and a worker hold at once, where the session sets none.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Bytes in and out of a task that leave no memory worth handing back.
SMALL = 1 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches, for settings that it hasn't made itself."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes (null: empty) and the named columns; other columns are left behind."""
    return docs.select("doc_id", F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("text"), *more)


def stage(df: DataFrame) -> DataFrame:
    """df as a table on the shared folder (see staging.py)."""
    small_batches(df.sparkSession)
    return staging.stage(df)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which hands freed memory back after more than SMALL bytes: workers live on, and share an executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                seen += batch.nbytes
                yield batch

        for batch in run(counted()):
            seen += batch.nbytes
            yield batch
        if seen <= SMALL:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def batches_of(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of at most `most` bytes together; one larger row stands alone."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(start, stop)
        start = stop


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  a cache of the worker process
    found = kept.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, _SLICE + 1), base, dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if len(found) <= 4 * _SLICE:
            kept[base] = found
    return found


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words `[^\\x20\\x09-\\x0D]+` of data, A-Z taken as a-z."""
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    gap = np.concatenate(([True], SPACE[raw], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))[: len(raw)], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw) + 1)[starts]
    return starts, mix(whole + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(text: bytes) -> list[bytes]:
    """A long text cut between words, so that memory stays bounded by its longest word."""
    found, at = [], 0
    while len(text) - at > _SLICE:
        cut = max(text.rfind(c, at, at + _SLICE) for c in (b" ", b"\n", b"\t"))
        if cut <= at:
            cut = min((x for c in (b" ", b"\n", b"\t") if (x := text.find(c, at + _SLICE)) > 0), default=len(text))
        found.append(text[at:cut])
        at = cut
    return [*found, text[at:]]


def word_hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, in order, and where each text's words begin (one more entry than texts)."""
    pieces = [(i, p) for i, text in enumerate(rows) for p in ([text] if len(text) <= _SLICE else _pieces(text))]
    counts, hashes = np.zeros(len(rows), dtype=np.int64), []
    for part in batches_of(np.array([len(p) + 1 for _, p in pieces]), _SLICE):
        chosen = pieces[part]
        begins = np.cumsum([0] + [len(p) + 1 for _, p in chosen[:-1]])
        starts, found = _words_of(b"\n".join(p for _, p in chosen))
        hashes.append(found)
        owner = np.array([i for i, _ in chosen])[np.searchsorted(begins, starts, side="right") - 1]
        counts += np.bincount(owner, minlength=len(rows))
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.concatenate(([0], np.cumsum(counts)))


def rows_of(batch: pa.RecordBatch, most: int = 2 << 20, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` bytes of its column of bytes or texts."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    for part in batches_of(sizes, most):
        yield batch.slice(part.start, part.stop - part.start)
