"""Offsets: ranges, the high-water mark, consumer cursors, segments, and as-of lookup in a sparse index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offset_range(log: DataFrame, low: int, high: int) -> DataFrame:
    """Records [low, high); the bounds reach the scan, where row groups are skipped by their statistics."""
    return log.where((F.col("log_offset") >= low) & (F.col("log_offset") < high))


def high_water_mark(log: DataFrame) -> DataFrame:
    """One row: the next offset the log would give; 0 for an empty log."""
    return log.agg((F.coalesce(F.max("log_offset"), F.lit(-1)) + 1).alias("next_offset"))


def latest_cursors(cursors: DataFrame) -> DataFrame:
    """Last write wins per consumer; among equal times the larger offset."""
    return cursors.groupBy("consumer").agg(F.max(F.struct("updated_at", "next_offset")).alias("c")).select("consumer", "c.next_offset", "c.updated_at")


def consumer_lag(cursors: DataFrame, log: DataFrame) -> DataFrame:
    """Records between each consumer's cursor and the end of the log; the mark is one row, so joining it shuffles nothing."""
    mark = high_water_mark(log).select(F.col("next_offset").alias("log_end"))
    return latest_cursors(cursors).join(F.broadcast(mark)).select("consumer", "next_offset", "log_end", F.greatest(F.lit(0), F.col("log_end") - F.col("next_offset")).alias("lag"))


def segments(log: DataFrame, records: int) -> DataFrame:
    """Segments of ``records`` offsets each: name, rows, first and last offset."""
    base = (F.floor(F.col("log_offset") / records) * records).cast("bigint")
    grouped = log.groupBy(base.alias("base_offset")).agg(F.count(F.lit(1)).alias("records"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"))
    return grouped.withColumn("segment", F.format_string("%020d.log", F.col("base_offset")))


def as_of(probes: DataFrame, entries: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """For each probe the ``value`` of the last entry at or before it within its partition, null if there is none.

    One shuffle by ``partition`` and one sort; no probe is paired with more than one entry.
    """
    both = probes.withColumn("__entry", F.lit(1)).unionByName(entries.select(partition, order, value).withColumn("__entry", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(partition).orderBy(order, "__entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(upto)).where("__entry = 1").drop("__entry")
