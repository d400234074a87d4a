"""One conversion from settings to a written zip."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession

from inkflow.config import Config, OptionError
from inkflow.operators.convert import convert, manifest
from inkflow.sources import archives, files
from inkflow.sources.zips import write_zip

log = logging.getLogger("inkflow")


def entries(spark: SparkSession, config: Config, heads: bool = False) -> DataFrame:
    """The pictures of the source; with heads, only as much of each as its header takes (rar files are read whole)."""
    if files.is_folder(spark, config.source):
        return archives.folder_entries(spark, config.source, heads=heads)
    if files.head(spark, config.source, 4) == b"Rar!":
        return archives.rar_entries(spark, config.source, config.password)
    return archives.zip_entries(spark, config.source, config.charsets, config.password, heads=heads)


def preview(spark: SparkSession, config: Config) -> DataFrame:
    """What run would do with each member, by headers alone: no picture is read whole."""
    return manifest(entries(spark, config, heads=True), config.ratio)


def run(spark: SparkSession, config: Config) -> int:
    """Writes config.output; the number of its members."""
    began = time.monotonic()
    if not files.exists(spark, config.source):
        raise OptionError(f"{config.source} does not exist")
    if files.exists(spark, config.output):
        raise OptionError(f"{config.output} exists")
    count = write_zip(convert(entries(spark, config), config.ratio, config.kernel, config.jpeg), config.output)
    log.info("%s: %d pictures", config.output, count)
    if config.delete_source:
        try:
            files.delete(spark, config.source)
        except OSError as error:
            log.error("%s stays: %s", config.source, error)
    if config.show_time or config.debug:
        log.info("%.2f s", time.monotonic() - began)
    return count
