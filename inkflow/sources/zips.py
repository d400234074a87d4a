"""Writes converted members as one zip file, by tasks.

Each task appends its members to a file of its own, in the order in which it converts them, and tells where they lie. Only these small rows
are sorted: a zip's directory gives the order of its members, wherever their bytes are. The offsets of the parts are a
running total over the tasks; directory entries are written by tasks again, in walk order; then parts, entries and end
records are joined into one file, which takes the output's name when it is whole.
"""

from __future__ import annotations

import logging
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.functions import jvm, names
from inkflow.sources import files
from inkflow.sources.archives import SOURCE, _java
from inkflow.staging import staged

log = logging.getLogger("inkflow")


def write_zip(converted: DataFrame, output: str) -> int:
    """Writes rows (path, out_path, out_content, warn_small) as a zip whose members come in walk order; their number.

    Contents go from the task that made them into its part file: they cross no shuffle and don't meet the driver, which
    holds a row for each part. No rows give a zip without members; equal names stay. A failing picture, or a name that has been
    taken meanwhile, fails the write, and nothing is left.
    """
    spark = converted.sparkSession
    folder = f"{output}.{uuid.uuid4().hex}.part"
    try:
        system, where = files.place(spark, folder)
        system.mkdirs(where)
        written = _java(spark, "bodies", converted.select("path", "out_path", "out_content", "warn_small"), where.toString())
        with staged(written) as members:  # the only pass over contents
            count = _finish(spark, members, where.toString())
            for row in members.filter("warn_small").select("path").orderBy(names.walk_key(F.col("path"))).toLocalIterator():
                log.warning("%s is too small to be resampled", row["path"])
        files.publish(spark, f"{folder}/whole", output)
    finally:
        files.remove_tree(spark, folder)
    return count


def _finish(spark: SparkSession, members: DataFrame, folder: str) -> int:
    """Writes the directory of members that lie in part files, and joins all into folder/whole."""
    # Local header, name and body of every member of a part.
    parts = members.groupBy("file").agg(F.sum(30 + F.octet_length("out_path") + F.col("size")).alias("bytes")).orderBy("file").collect()  # one for each task that wrote
    _seen(spark, folder, {p["file"]: p["bytes"] for p in parts})
    bases = list(accumulate((p["bytes"] for p in parts), initial=0))
    base = spark.createDataFrame([(p["file"], b) for p, b in zip(parts, bases, strict=False)], "file string, base long")
    placed = members.join(F.broadcast(base), "file").withColumns({"at": F.col("at") + F.col("base"), "key": names.walk_key(F.col("path"))})
    ordered = placed.repartitionByRange("key", "path", "at").sortWithinPartitions("key", "path", "at").select("out_path", "at", "size", "crc")
    entries = sorted(_java(spark, "entries", ordered, folder).collect())  # one for each task that wrote
    count, start = sum(e["members"] for e in entries), bases[-1]
    starts = list(accumulate((e["bytes"] for e in entries), initial=start))
    jvm.call(spark, jvm.load(spark, SOURCE), "finish", spark._jsparkSession, f"{folder}/end", start, starts[-1] - start, count)
    system, end = files.place(spark, f"{folder}/end")
    total = starts[-1] + system.getFileStatus(end).getLen()
    pieces = [*zip((p["file"] for p in parts), bases, strict=False), *zip((e["file"] for e in entries), starts, strict=False), (f"{folder}/end", starts[-1])]
    jvm.call(spark, jvm.load(spark, SOURCE), "joined", spark.createDataFrame(pieces, "file string, at long").orderBy("at")._jdf, f"{folder}/whole")
    _seen(spark, folder, {f"{folder}/whole": total})
    return count


def _seen(spark: SparkSession, folder: str, sizes: dict[str, int]) -> None:
    """Raises unless the driver sees the files that tasks wrote, whole: a local folder of a cluster isn't shared."""
    system, where = files.place(spark, folder)
    found = {s.getPath().getName(): s.getLen() for s in system.listStatus(where)}
    if missing := [path for path, size in sizes.items() if found.get(path.rsplit("/", 1)[1]) != size]:
        raise OSError(f"{missing[0]} isn't what a task wrote; do the driver and all executors share the output's folder?")
