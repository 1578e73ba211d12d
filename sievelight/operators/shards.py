"""Rows in order, dealt to documents of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: Rows a document holds at most.
PER_DOCUMENT = 50_000
_IN_PART = (1 << 33) - 1


def dealt(rows: DataFrame, order: Column, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Adds `o`, the order, and `shard`, from 0 on: so many rows in order go to each document.  Staged.

    Rows are sorted by ranges in many tasks; a row's place is its place in its range plus
    the rows of the ranges before, of which there is one count each.
    """
    ranged = rows.withColumn("o", order)
    ranged = stage(ranged.repartitionByRange("o").sortWithinPartitions("o").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each range
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit(_IN_PART))
    return placed.withColumn("shard", F.floor(place / per_document)).drop("_id", "_part", "_before")


def joined(name: str) -> Column:
    """The JSON texts of a document in order, parted by commas; an aggregate over one shard."""
    listed = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("o", name))))
    return F.array_join(F.transform(listed, lambda x: x[name]), ",")
