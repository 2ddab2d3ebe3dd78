"""Daily usage by event time, corrected as late rows arrive and closed to rows past the cut-off.

The event-time window is a UTC day of ``occurred_at``. Rows are taken in order of arrival, so the watermark at a row is its
``received_at`` less the allowed lateness; a row behind it is diverted to the report of dropped rows. The state is keyed by
(tenant_id, meter, window). Each arrival day that touches a key emits an upsert with the key's new totals, so the last version
of a key is its corrected total, and every earlier version is what was known at the time. An upsert whose arrival day begins
when its window is already over corrects a total that had been given out; ``corrections`` finds the rows behind such upserts.

Raw rows meet the upserts by key only in ``corrections``, where keys that hold many rows take the way of ``skew_join``.

Nulls and bad rows: a null tenant is a tenant of its own; rows without key, meter, times or plain quantity go to the report
with their reason. Second deliveries change no total and are not reported here. Empty input gives empty outputs. Extra
columns are ignored, whatever their names. A total with more digits than DECIMAL(38,9) holds raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.quantity import as_decimal
from tallymill.operators.counted import verdict
from tallymill.operators.dedup_index import first_deliveries
from tallymill.operators.skew import skew_join
from tallymill.session import written

STATE_KEY = ["tenant_id", "meter", "usage_day"]


@dataclass
class LateWindows:
    routed: DataFrame
    """Rows in time: log_offset, the state key, over_on, arrival_day, quantity."""
    upserts: DataFrame
    """State key, version, arrival_day, quantity, events, corrections, is_correction: one row per key and arrival day."""
    diverted: DataFrame
    """log_offset, reason: rows that changed no total, second deliveries aside."""


def route(events: DataFrame) -> DataFrame:
    """The kept copies that are in time, each with its window: log_offset, the state key, over_on (the day the window is over), arrival_day, quantity."""
    window = F.window("occurred_at", "1 day")
    in_time = events.where(verdict().isNull()).join(first_deliveries(events), "log_offset", "left_semi")
    rows = in_time.select("log_offset", "tenant_id", "meter", window.alias("w"), F.to_date("received_at").alias("arrival_day"), as_decimal().alias("quantity"))
    return rows.select("log_offset", "tenant_id", "meter", F.to_date("w.start").alias("usage_day"), F.to_date("w.end").alias("over_on"), "arrival_day", "quantity")


def upserts_of(routed: DataFrame) -> DataFrame:
    """What the keyed state emits: a version of a key for each arrival day that touches it."""
    # partial aggregation leaves at most one row per key and arrival day and task, whatever the tenant's size
    per_arrival = routed.groupBy(*STATE_KEY, "arrival_day").agg(F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), (F.col("arrival_day") >= F.max("over_on")).alias("late"))
    state = Window.partitionBy(*STATE_KEY).orderBy("arrival_day")
    so_far = state.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_arrival.select(
        *STATE_KEY,
        F.row_number().over(state).cast("bigint").alias("version"),
        "arrival_day",
        F.sum("q").over(so_far).cast("decimal(38,9)").alias("quantity"),
        F.sum("n").over(so_far).alias("events"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))).over(so_far), F.lit(0)).alias("corrections"),
        F.col("late").alias("is_correction"),
    )


def late_windows(events: DataFrame) -> LateWindows:
    """Route every row and build the keyed state's upserts."""
    routed = route(events)
    judged = events.withColumn("reason", verdict())
    diverted = judged.where(F.col("reason").isNotNull()).select("log_offset", "reason", "tenant_id", "meter", "occurred_at", "received_at")
    return LateWindows(routed, upserts_of(routed), diverted)


def corrections(events: DataFrame) -> DataFrame:
    """(log_offset): the rows whose arrival made the state correct a window already over. Routed rows are written once, for the state and for this."""
    routed = written(route(events), "routed")
    emitted = upserts_of(routed).where("is_correction").select(*STATE_KEY, "arrival_day")
    return skew_join(routed.select("log_offset", *STATE_KEY, "arrival_day"), emitted, [*STATE_KEY, "arrival_day"], how="left_semi").select("log_offset")


def latest(upserts: DataFrame) -> DataFrame:
    """What the table holds when all upserts are applied: the highest version of each key, in one aggregation."""
    last = F.max(F.struct("version", "arrival_day", "quantity", "events", "corrections")).alias("last")
    return upserts.groupBy(*STATE_KEY).agg(last).select(*STATE_KEY, "last.version", "last.quantity", "last.events", "last.corrections")
