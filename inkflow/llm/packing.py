"""Shortest-pack-first packing over the length histogram.

Documents become token ids; ids are cut into pieces of at most `size`; only the histogram of
piece lengths reaches the driver (at most `size` counts). There, lengths are placed longest first
into the emptiest open pattern that has room, and patterns carry counts, so the work depends on
`size` and not on the corpus. Each piece then finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm import vocab
from inkflow.llm.common import lean, rows_of, stage, table, texts

SIZE, END_ID, PER_GROUP = 2048, 1, 500
#: White space from which on a run is encoded apart: the library's pattern recurses once for each character of a run.
RUN = 1 << 14
# The characters that the pattern counts as white space.
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(f"(?<!{_SPACES}){_SPACES}{{{RUN},}}")
#: Groups of one length whose running totals one task makes.
GROUPS = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _ordinary(ranks_path: str) -> Callable[[str], list[int]]:
    """encode_ordinary, for any white space.

    The pattern matches a run as one piece where the text ends with it, and else all but its last character; what stands
    before and behind is matched as if it stood alone.
    """
    encoding = vocab.encoding(ranks_path)

    def encode(text: str) -> list[int]:
        if len(text) < RUN:
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += encoding.encode_ordinary(text[at : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + encoding.encode_ordinary(text[at:])

    return encode


def encoder(ranks_path: str = vocab.RANKS, json_path: str = vocab.JSON) -> Callable[[str], list[int]]:
    """A text's ids as the JSON tokenizer's encode gives them: its added tokens are cut out first, the longest where several start."""
    ordinary, added = _ordinary(ranks_path), vocab.added(json_path)
    if not added:
        return ordinary
    tokens = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def encode(text: str) -> list[int]:
        parts = tokens.split(text)
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) for i in ((added[part],) if k % 2 else ordinary(part))]

    return encode


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, ranks_path: str = vocab.RANKS, json_path: str = vocab.JSON) -> DataFrame:
    """Each document's ids and `end_id`, cut at multiples of `size`: one row per piece, and a number for it (row).

    The rank file holds the vocabulary of the JSON tokenizer: ids are the same (a test holds them
    together) at a quarter of the CPU time. Strings of the JSON file's added tokens become their ids. A null text is empty: its one piece is `end_id`. Rows
    that repeat, or lack a doc_id, are documents of their own. A text is encoded whole.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path)
        for batch in batches:
            found: list[tuple] = []
            for part in rows_of(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text.decode("utf-8", "replace")), end_id], dtype="<u4")
                    found += [(doc_id, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes()), len(ids)) for at in range(0, len(ids), size)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(lean(cut), PIECES).withColumn("row", F.monotonically_increasing_id())


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: patterns of lengths that fill at most `size`, and how many sequences each describes.

    Every step either uses up a length or extends the whole of an open pattern, so the number of
    patterns depends on `size` only.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []
    closed: list[tuple[tuple[int, ...], int]] = []

    def add(lengths: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            closed.append((lengths, count))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left, extended = histogram[length], []
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            lengths, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            used = min(left, count)
            left -= used
            if used < count:
                add(lengths, count - used, room)
            # A pack can take the same length again, once every emptier pack has had its turn.
            add((*lengths, length), used, room - length)
        if left:
            fits = size // length
            whole, rest = divmod(left, fits)
            extended += [((length,) * fits, whole)] * bool(whole) + [((length,) * rest, 1)] * bool(rest)
        for lengths, count in extended:
            add(lengths, count, size - sum(lengths))
    return closed + [x for room in rooms for x in open_[room]]


def _slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ordered by first rank."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def pack(cut: DataFrame, size: int = SIZE, per_group: int = PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES and row), which are read three times: stage them first.

    Ranks among equal lengths come from salted groups of about `per_group` pieces and the running
    totals of those groups, in two levels, so that no task sorts all pieces, or all groups, of a frequent length. Pieces that repeat, or
    lack a doc_id, are dealt out like others. No pieces give no rows.
    """
    counted = cut.groupBy("length").agg(F.count("*").alias("of_length"))  # at most `size` rows
    slots = _slots(patterns({r["length"]: r["of_length"] for r in counted.collect()}, size))
    salted = cut.join(F.broadcast(counted), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("of_length") / per_group)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("salt") / GROUPS))
    running = lambda n, *keys: F.sum(n).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col(n)
    parts = groups.groupBy("length", "part").agg(F.sum("n").alias("m")).select("length", "part", running("m", "length", "part").alias("of_parts"))
    before = groups.withColumn("of_groups", running("n", "length", "part", "salt")).join(parts, ["length", "part"]).select("length", "salt", (F.col("of_parts") + F.col("of_groups")).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1).join(before, ["length", "salt"])
    shared = cut.sparkSession.sparkContext.broadcast(slots)  # its size depends on `size` only

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                table_ = shared.value[int(length[rows[0]])]
                at = np.searchsorted(table_[:, 0], rank[rows], side="right") - 1
                sequence[rows], offset[rows] = table_[at, 1] + rank[rows] - table_[at, 0], table_[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "base").mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(table(spark, sf_dir, "documents"))))
