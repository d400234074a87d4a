"""Places in an order, and ordered lists, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import names
from inkflow.staging import stage

#: Rows of running totals that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Members of one row of a list.
CHUNK = 1000
_ROW = 33  # bits of a row's number in its partition, in monotonically_increasing_id


def ranked(rows: DataFrame, by: str, order: Sequence[Column], place: str = "place") -> DataFrame:
    """Adds each row's place (from 1) among those with its value of `by`, in ascending order; ties get different places.

    Rows are dealt by ranges of (by, order) and sorted there; a row's number in its range, and how many rows of its group lie in
    the ranges before, make its place. So a group may fill any number of tasks, and only counts, one for each range and group, are
    added up. Null is a group of its own. Rows are staged once, so leave contents out.
    """
    keys = [f"key{i}_" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)))
    dealt = keyed.repartitionByRange(by, *keys).sortWithinPartitions(by, *keys).drop(*keys)
    fixed = stage(dealt.withColumn("id_", F.monotonically_increasing_id())).withColumn("range_", F.shiftright("id_", _ROW))
    counts = fixed.groupBy(by, "range_").agg(F.count("*").alias("n"), F.min("id_").alias("first_"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("range_")) - F.col("n")  # a row for each range that holds some of the group
    starts = counts.select(F.col(by).alias("by_"), F.col("range_").alias("of_"), (before - F.col("first_")).alias("shift_"))
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = fixed.join(F.broadcast(starts) if few else starts, F.col(by).eqNullSafe(F.col("by_")) & (F.col("range_") == F.col("of_")))
    return found.select(*rows.columns, (F.col("id_") + F.col("shift_") + 1).alias(place))


def member_lists(members: DataFrame, size: int = CHUNK) -> DataFrame:
    """archive, chunk (from 0), n, members: the paths of an archive's rows in walk order, `size` in a row at most."""
    placed = ranked(members.select("archive", "path"), "archive", [names.walk_key(F.col("path"))])
    listed = placed.groupBy("archive", F.floor((F.col("place") - 1) / size).alias("chunk")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "path"))).alias("found"))
    return listed.select("archive", "chunk", "n", F.col("found.path").alias("members"))
