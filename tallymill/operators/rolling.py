"""Trailing totals and averages per entity and day, days without activity included.

Block decomposition: the days of an entity are cut into blocks of the window's length. Within a block run a prefix sum
(from its first day) and a suffix sum (to its last day). The trailing window that ends on a day covers a suffix of the
block before and a prefix of the day's own block, so each total is one addition, whatever the window's length.

Rows are thinned to one per entity and day before the only shuffle, so a hot entity costs no more than its days. Nulls: a
null entity column is a value of its own; rows with null day or amount take no part. A day after ``last_day`` takes no part.
A total with more digits than DECIMAL(38,9) holds raises an error: a wrong total would be worse.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(rows: DataFrame, entity: list[str], day: Column, amount: Column) -> DataFrame:
    """(entity, day, total): sums per day; the only step that sees all rows."""
    return rows.select(*entity, day.alias("day"), amount.alias("amount")).where("day is not null and amount is not null").groupBy(*entity, "day").agg(F.sum("amount").alias("total"))


def dense(totals: DataFrame, entity: list[str], last_day: datetime.date) -> DataFrame:
    """Every day of every entity from its first to ``last_day``, total 0 where there was none; ``i`` counts them from 0.

    Each day with activity brings the idle days up to the next one, so rows stay narrow and nothing is gathered per entity.
    """
    series = Window.partitionBy(*entity).orderBy("day")
    gaps = totals.where(F.col("day") <= F.lit(last_day)).withColumns({"__first": F.first("day").over(series), "__next": F.lead("day").over(series)})
    upto = F.coalesce(F.date_sub("__next", 1), F.lit(last_day))
    days = gaps.select(*entity, "total", "__first", F.posexplode(F.sequence("day", upto)).alias("__idle", "day"))
    return days.select(*entity, "day", F.date_diff("day", "__first").alias("i"), F.when(F.col("__idle") == 0, F.col("total")).otherwise(F.lit(0)).cast("decimal(38,9)").alias("total"))


def _plus(a: Column, b: Column) -> Column:
    """a + b with all nine fraction digits: the sum of two DECIMAL(38,9) would be typed with eight.

    Where one side has 29 integer digits, it can only be added to zero.
    """
    alone = F.when(b == 0, a).when(a == 0, b)
    return F.coalesce(a.try_cast("decimal(37,9)") + b.try_cast("decimal(37,9)"), alone, F.raise_error(F.lit("a trailing total has more than 28 integer digits")).cast("decimal(38,9)"))


def rolling(rows: DataFrame, entity: list[str], day: Column, amount: Column, last_day: datetime.date, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, usage_day, quantity, total_W and average_W for each window length W).

    Averages divide by the window's length, idle days included, also before the entity's first day.
    """
    out = dense(daily(rows, entity, day, amount), entity, last_day)
    for w in windows:
        block = Window.partitionBy(*entity, f"block_{w}").orderBy("i")
        prefix = F.sum("total").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        suffix = F.sum("total").over(block.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        out = out.withColumn(f"block_{w}", F.floor(F.col("i") / w).cast("int")).withColumns({f"prefix_{w}": prefix, f"suffix_{w}": suffix})
    series = Window.partitionBy(*entity).orderBy("i")
    for w in windows:
        # on a block's last day the window is the block itself; else it starts w-1 days back, in the block before
        before = F.when(F.pmod("i", F.lit(w)) == w - 1, F.lit(0).cast("decimal(38,9)")).otherwise(F.coalesce(F.lag(f"suffix_{w}", w - 1).over(series), F.lit(0)))
        out = out.withColumn(f"total_{w}", _plus(F.col(f"prefix_{w}"), before.cast("decimal(38,9)")))
    averages = [x for w in windows for x in (F.col(f"total_{w}"), (F.col(f"total_{w}") / F.lit(w)).cast("decimal(38,9)").alias(f"average_{w}"))]
    return out.select(*entity, F.col("day").alias("usage_day"), F.col("total").alias("quantity"), *averages)
