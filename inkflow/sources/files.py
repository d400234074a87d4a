"""Files on any of Hadoop's file systems, through the driver's JVM. Contents don't pass here, but for a file's first bytes."""

from __future__ import annotations

import os

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from inkflow.config import is_local


def place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path's file system and the path, qualified. The name is taken as it is, without patterns."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    # A local name may hold what would be a scheme, a query or an escape in a URI.
    found = hadoop.Path(None, None, path) if path.startswith("/") else hadoop.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(found)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = place(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = place(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, fewer where it is shorter."""
    files, where = place(spark, path)
    size = min(size, files.getFileStatus(where).getLen())
    stream = files.open(where)
    try:
        found = bytearray()
        while len(found) < size:
            found.append(stream.read())
        return bytes(found)
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or an empty folder; raises OSError where that doesn't work."""
    files, where = place(spark, path)
    try:
        gone = files.delete(where, False)
    except Py4JJavaError as error:
        raise OSError(error.java_exception.getMessage()) from error
    if not gone:
        raise OSError(f"{path} can't be deleted")


def remove_tree(spark: SparkSession, path: str) -> None:
    files, where = place(spark, path)
    files.delete(where, True)


def publish(spark: SparkSession, temporary: str, path: str) -> None:
    """Gives a finished file its name; one that has been taken meanwhile stays, and FileExistsError is raised."""
    if is_local(path):
        os.link(temporary, path)  # no check and rename in two steps
        os.remove(temporary)
        return
    _, source = place(spark, temporary)
    _, target = place(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, options)  # without OVERWRITE
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise FileExistsError(f"{path} exists") from error
        raise
