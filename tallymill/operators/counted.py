"""Which usage rows count, and why the others don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keys import has_key
from tallymill.functions.quantity import as_decimal, is_plain
from tallymill.operators.dedup_index import first_deliveries

#: How far occurred_at may lie before and after received_at, both included.
LATENESS_SECONDS = 35 * 24 * 3600
EARLINESS_SECONDS = 5 * 60


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


def watermark_micros(lateness: int = LATENESS_SECONDS) -> Column:
    """Rows are taken in order of arrival, so the watermark as a row arrives is its own arrival less the allowed lateness."""
    return _micros("received_at") - F.lit(lateness * 1_000_000)


def verdict(lateness: int = LATENESS_SECONDS, earliness: int = EARLINESS_SECONDS) -> Column:
    """Null for a row that can count by its own columns, else the reason why it can't."""
    return (
        F.when(~has_key(), "no_key")
        .when(F.col("meter").isNull(), "no_meter")
        .when(F.col("occurred_at").isNull() | F.col("received_at").isNull(), "no_time")
        .when(~is_plain(), "bad_quantity")
        .when(_micros("occurred_at") < watermark_micros(lateness), "too_late")
        .when(_micros("occurred_at") > _micros("received_at") + F.lit(earliness * 1_000_000), "too_early")
    )


def counted(events: DataFrame) -> DataFrame:
    """The kept copies that count, with quantity as DECIMAL(38,9).

    Rows are filtered by their own columns first; then a semi-join on the unique offset keeps the first deliveries. No
    operation here groups or joins by tenant or key without thinning beforehand, so hot keys don't matter.
    """
    return events.where(verdict().isNull()).join(first_deliveries(events), "log_offset", "left_semi").withColumn("quantity", as_decimal())
