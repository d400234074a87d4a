"""Converts the pictures, or archives of pictures, that appear in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkflow.functions import names
from inkflow.operators.convert import convert
from inkflow.sources import archives, files

#: Bytes of archives that one batch admits (one larger archive is a batch of its own), and packed bytes of a batch's slice.
ADMITTED = 1 << 30


def _below(path, base: str):
    return F.substring(path, F.lit(len(base) + 2), F.char_length(path))


def _qualified(spark: SparkSession, folder: str) -> str:
    return files.place(spark, folder)[1].toString().rstrip("/")


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Takes what is there now, and on the next call what came since; converted members go to Parquet.

    Files are taken exactly once: the stream's checkpoint holds what was read, and each batch
    replaces its own part of the output when it runs again. Members are named by their path below the folder, and those
    below its .git are left out, as folder_entries does; latest() reads the result.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    base = _qualified(spark, folder)
    kept = found.withColumn("path", _below(F.col("path"), base)).filter(names.is_picture(F.col("path")) & names.outside_git(F.col("path")))
    rows = kept.select(F.lit(base).alias("archive"), "path", names.extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.lit(None).cast("int").alias("mode"), F.col("modificationTime").alias("mtime"), "content")

    def write(batch: DataFrame, number: int) -> None:
        convert(batch, **options).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_archives(spark: SparkSession, folder: str, output: str, checkpoint: str, admitted: int = ADMITTED, charsets: tuple[str, ...] = ("ShiftJIS", "GB18030"), password: str | None = None, **options) -> StreamingQuery:
    """The same for zip files that appear in a folder: their pictures, converted, go to Parquet.

    A batch admits archives of `admitted` bytes together, or one larger one, by their length; their contents aren't read by the stream. A
    batch is done in slices: the members that begin within the same `admitted` bytes of their archive. A slice that
    was finished stays when its batch runs again after a failure, one that wasn't is replaced, so a restart in the middle of an
    archive repeats no finished slice, loses no member and brings none twice. Memory depends on single members only.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[zZ][iI][pP]").option("maxBytesPerTrigger", str(admitted)).load(folder).select("path", "length")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        largest = batch.agg(F.max("length")).first()[0] or 0
        tasks = archives.tasks_for(session, min(largest, admitted))
        for at in range(0, largest, admitted):
            target = f"{output}/batch={number}/slice={at // admitted}"
            if files.exists(session, f"{target}/_SUCCESS"):
                continue
            members = archives.pictures(archives.listed(session, batch, charsets)).filter((F.col("at") >= at) & (F.col("at") < at + admitted))
            entries = archives.opened(archives.dealt(members, tasks, admitted), password)
            convert(entries, **options).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The converted members in walk order; of a picture that was written several times, the last one."""
    return archives.last_written(spark.read.parquet(output), ["archive", "path"], "batch").orderBy("archive", names.walk_key(F.col("path")))
