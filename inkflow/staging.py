"""Tables on the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset and all run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame) -> DataFrame:
    """Writes df below the shared folder and reads it back: lineage ends here, and lost executors cost nothing.

    The table is deleted when the driver's Python ends.
    """
    found, path = _written(df)
    atexit.register(_delete, df.sparkSession, path)
    return found


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """The same for as long as the context lasts."""
    found, path = _written(df)
    try:
        yield found
    finally:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
