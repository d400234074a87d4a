"""Members of zip files and folders as rows.

A container is listed without its contents: zip files by their directory, which a task reads as a stream from the file's tail;
folders by a walk. Names are filtered and equal names settled on these small rows. They are then dealt out by byte ranges, and each task
reads its members by ranges of the file, so no archive is ever one value and no content crosses a shuffle. A filter on names,
wherever it stands in a query, goes below the reading, and a query without contents reads none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.config import CODECS
from inkflow.functions import jvm, names
from inkflow.sources import files

ENTRIES = "archive string, path string, ext string, size long, mode int, mtime timestamp, content binary"
SOURCE = Path(__file__).parent / "java" / "Containers.java"
#: Packed bytes that one task reads, about, in how many ranges of an archive, and the most tasks that members are dealt to.
SPLIT, RANGES, MOST_TASKS = 64 << 20, 8, 100_000


class ArchiveError(ValueError):
    """A container that cannot be read as it should."""


def workers(cpus: int) -> int:
    """Tasks that a conversion keeps busy: all cores but one, and four at least."""
    return cpus - 1 if cpus >= 5 else 4


def intact(read: Column, size: Column) -> Column:
    """Whether as much was read as was announced."""
    return read == size


def last_written(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys, the one that comes last in order, with all columns."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("last_")).select(*keys, *(f"last_.{c}" for c in others))


def _java(spark: SparkSession, name: str, rows: DataFrame, *arguments) -> DataFrame:
    return DataFrame(jvm.call(spark, jvm.load(spark, SOURCE), name, rows._jdf, *arguments), spark)


def _found(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the zip files that a name means: itself, those in a folder, or those of a pattern."""
    system, where = files.place(spark, path)
    if system.exists(where):
        status = [system.getFileStatus(where)]
        if status[0].isDirectory():
            status = [s for s in system.listStatus(where) if s.isFile() and s.getPath().getName().lower().endswith(".zip")]
    else:
        status = list(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) or [])
    if not status:
        raise ArchiveError(f"{path}: no such archive")
    return sorted((s.getPath().toString(), s.getLen()) for s in status)


def zip_members(spark: SparkSession, path: str, charsets: Sequence[str] = ("ShiftJIS", "GB18030")) -> DataFrame:
    """What the directories of zip files (a path, folder or pattern) list, folders left out: a row per listed file, without contents.

    place counts the rows of a directory; at is where the member's own header begins in `file`.
    """
    return listed(spark, spark.createDataFrame(_found(spark, path), "path string, length long"), charsets)


def listed(spark: SparkSession, archives: DataFrame, charsets: Sequence[str]) -> DataFrame:
    """The same for rows (path, length), each archive by one task, which holds one entry at a time."""
    return _java(spark, "members", archives.select("path", "length"), ",".join(CODECS[c] for c in charsets))


def opened(members: DataFrame, password: str | None = None, heads: bool = False) -> DataFrame:
    """ENTRIES of members: content by one ranged read each, where it is asked for; a size or checksum that differs fails the query.

    heads: only as many of a picture's first bytes as its header takes are fetched and unpacked, without a check.
    """
    spark = members.sparkSession
    jvm.call(spark, jvm.load(spark, SOURCE), "reader", spark._jsparkSession, password)
    content = F.call_function("inkflow_head" if heads else "inkflow_member", *(F.col(c) for c in ("file", "path", "at", "packed", "size", "crc", "method", "flags")))
    return members.select("archive", "path", names.extension(F.col("path")).alias("ext"), "size", "mode", F.try_to_timestamp("mtime").alias("mtime"), content.alias("content"))


def pictures(members: DataFrame) -> DataFrame:
    """Those with a picture's ending outside of .git; of a name listed twice the last one counts."""
    kept = members.filter(names.is_picture(F.col("path")) & names.outside_git(F.col("path")))
    return last_written(kept, ["archive", "path"], "place")


def dealt(members: DataFrame, tasks: int, size: int | None = None) -> DataFrame:
    """Members dealt to a number of tasks: byte ranges of archives in turn, by their size together, or single files by hash."""
    step = max(1, min(size // (tasks * RANGES), SPLIT)) if size else None
    turn = F.xxhash64("archive") + F.floor(F.col("at") / step) if step else F.xxhash64("archive", "path")
    return members.repartitionById(tasks, F.pmod(turn, tasks).cast("int"))


def tasks_for(spark: SparkSession, size: int) -> int:
    return min(max(workers(spark.sparkContext.defaultParallelism), -(-size // SPLIT)), MOST_TASKS)


def zip_entries(spark: SparkSession, path: str, charsets: Sequence[str] = ("ShiftJIS", "GB18030"), password: str | None = None, partitions: int | None = None, heads: bool = False) -> DataFrame:
    """The pictures of zip files (a path, folder or pattern): ENTRIES, of which a task reads SPLIT bytes, about."""
    found = _found(spark, path)
    size = sum(length for _, length in found)
    tasks = partitions or tasks_for(spark, size)
    members = listed(spark, spark.createDataFrame(found, "path string, length long"), charsets)
    return opened(dealt(pictures(members), tasks, size), password, heads)


def folder_members(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, as members. Its subfolders are walked by tasks; .git at the root is not entered."""
    system, where = files.place(spark, path)
    root = where.toString().rstrip("/")
    starts = [(root, s.getPath().getName()) for s in system.listStatus(where) if s.getPath().getName() != ".git" or s.isFile()]
    return _java(spark, "walk", spark.createDataFrame(starts, "root string, start string"))


def folder_entries(spark: SparkSession, path: str, partitions: int | None = None, heads: bool = False) -> DataFrame:
    """The pictures below a folder: ENTRIES. Endings are tested at the listing, so other files aren't opened."""
    found = pictures(folder_members(spark, path))
    tasks = partitions or tasks_for(spark, found.agg(F.sum("size")).first()[0] or 0)
    return opened(dealt(found, tasks), heads=heads)


def rar_entries(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """The pictures of rar files, where the optional rarfile module (and its unpacker) is installed on the executors."""
    try:
        import rarfile  # noqa: F401
    except ImportError as error:
        raise ArchiveError("reading rar files needs the optional module rarfile") from error

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import rarfile

        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with rarfile.RarFile(io.BytesIO(content)) as opened:
                    for info in opened.infolist():
                        if not info.is_dir():
                            yield pa.RecordBatch.from_pylist([{"archive": archive, "path": info.filename, "size": info.file_size, "content": opened.read(info, pwd=password)}])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(listed, "archive string, path string, size long, content binary")
    kept = found.filter(names.is_picture(F.col("path")) & names.outside_git(F.col("path")))
    return kept.select("archive", "path", names.extension(F.col("path")).alias("ext"), "size", F.lit(None).cast("int").alias("mode"), F.lit(None).cast("timestamp").alias("mtime"), "content")
