"""The small ``events`` table as a delivery log: redeliveries, reused keys and late arrivals derived from its own columns.

Every 7th event is delivered again with one more trailing zero, every 11th comes again under the same key with one unit
more. Most arrive up to 39 days late, a few exactly on the limits. Its doubles are read once, as two decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.fingerprint import fingerprint, rfc3339_nano
from tallymill.functions.validation import rejection
from tallymill.operators.classify import classify
from tallymill.sources.tables import table


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with ``occurred_at`` as RFC 3339 text, as a client sends it."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    k = F.col("event_id")
    delay = F.when(k % 97 == 0, -10 * 60).when(k % 89 == 0, -5 * 60).when(k % 83 == 0, 35 * 86400).otherwise((k % 40) * 86400)
    copies = F.filter(F.array(F.struct(F.lit(0).alias("copy"), F.col("v").cast("string").alias("quantity")), F.when(k % 7 == 0, F.struct(F.lit(1).alias("copy"), F.concat(F.col("v").cast("string"), F.lit("0")).alias("quantity"))), F.when(k % 11 == 0, F.struct(F.lit(2).alias("copy"), (F.col("v") + 1).cast("decimal(18,2)").cast("string").alias("quantity")))), lambda c: c.isNotNull())
    rows = e.select("*", F.explode(copies).alias("c"), F.timestamp_micros(F.unix_micros("ts") + delay * 1_000_000).alias("received_at"))
    return rows.select((k * 3 + F.col("c.copy")).alias("log_offset"), F.concat(F.lit("u"), "user_id").alias("tenant_id"), F.col("event_type").alias("meter"), "c.quantity", rfc3339_nano(F.col("ts")).alias("occurred_at"), "received_at", F.concat(F.lit("k"), k).alias("idempotency_key"))


def adapter_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries and quantity per outcome: refused by a rule, or inserted, duplicate or conflict."""
    log = delivery_log(spark, sf_dir).withColumn("r", rejection(F.col("received_at")))
    refused = log.where("r is not null").select(F.col("r.code").alias("outcome"), "quantity")
    good = log.where("r is null").withColumn("fingerprint", fingerprint(F.col("tenant_id"), F.col("meter"), F.col("quantity"), F.col("occurred_at")))
    everything = refused.unionByName(classify(good).select("outcome", "quantity"))
    return everything.groupBy("outcome").agg(F.count(F.lit(1)).alias("deliveries"), F.sum(F.col("quantity").cast("decimal(20,2)")).cast("decimal(20,2)").cast("string").alias("quantity"))


QUERIES = {"adapter_outcomes": adapter_outcomes}

ORACLE = {
    "adapter_outcomes": """with c as (select event_id, 0 as copy, cast(value as decimal(18,2)) as q from events union all select event_id, 1, cast(value as decimal(18,2)) from events where event_id % 7 = 0
        union all select event_id, 2, cast(value as decimal(18,2)) + 1 from events where event_id % 11 = 0),
      l as (select c.*, case when event_id % 97 = 0 then -600 when event_id % 89 = 0 then -300 when event_id % 83 = 0 then 3024000 else (event_id % 40) * 86400 end as delay from c),
      j as (select *, case when delay < -300 then 'invalid_field' when delay > 3024000 then 'event_too_old' end as refused from l),
      f as (select *, first_value(q) over (partition by event_id order by copy) as fq, row_number() over (partition by event_id order by copy) as n from j where refused is null),
      o as (select refused as outcome, q from j where refused is not null union all select case when n = 1 then 'inserted' when q = fq then 'duplicate' else 'conflict' end, q from f)
      select outcome, count(*) as deliveries, cast(cast(sum(q) as decimal(20,2)) as varchar) as quantity from o group by outcome""",
}
