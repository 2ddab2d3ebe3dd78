"""Queries over the delivery log: repeated, late, skewed and rolling (problems 1, 2, 4 and 5)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.keys import has_key
from tallymill.functions.quantity import as_decimal
from tallymill.operators.counted import counted
from tallymill.operators.dedup_index import exactly_once, redeliveries
from tallymill.operators.late_windows import corrections, late_windows, latest
from tallymill.operators.rolling import rolling
from tallymill.operators.skew import keys_with_share, skew_aggregate, skew_join
from tallymill.sources.tables import table
from tallymill.streaming.late_stream import stream_totals

#: The last day of the delivery log, on which the trailing periods end.
LAST_DAY = datetime.date(2026, 8, 3)


def _plain(df: DataFrame) -> DataFrame:
    """Dates and decimals as text and instants as microseconds, which every engine prints alike."""
    as_text = {"date": lambda c: F.date_format(c, "yyyy-MM-dd"), "timestamp": F.unix_micros}
    return df.select(*[(as_text[t](c) if t in as_text else F.col(c).cast("string") if t.startswith("decimal") else F.col(c)).alias(c) for c, t in df.dtypes])


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_events")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a key and isn't the kept copy of its message."""
    return redeliveries(_usage(spark, sf_dir))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one copy of each message."""
    return _plain(exactly_once(_usage(spark, sf_dir)).select("log_offset", "tenant_id", "idempotency_key", "received_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted rows that correct a day already over when they arrived."""
    return corrections(_usage(spark, sf_dir))


def p2_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of each daily total, in the order in which they became known."""
    return _plain(late_windows(_usage(spark, sf_dir)).upserts.drop("is_correction"))


def p2_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected totals: the last version of each day."""
    return _plain(latest(late_windows(_usage(spark, sf_dir)).upserts))


def p2_diverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that changed no total, with the reason; too_late are those past the cut-off."""
    return _plain(late_windows(_usage(spark, sf_dir)).diverted)


def p2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected totals from the stream: deliveries in three batches by arrival, event-time windows behind a watermark, upserts."""
    return _plain(stream_totals(_usage(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants that hold at least 1/50 of all rows."""
    return keys_with_share(_usage(spark, sf_dir).select("tenant_id"), "tenant_id", 1 / 50).select("tenant_id")


def p4_tenant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant: rows, rows with a key, plain quantity in total, first and last arrival."""
    rows = _usage(spark, sf_dir).select("tenant_id", as_decimal().alias("q"), has_key().cast("bigint").alias("k"), "received_at")
    partial = {"n": F.count(F.lit(1)), "k": F.sum("k"), "q": F.sum("q"), "a": F.min("received_at"), "z": F.max("received_at")}
    final = {"deliveries": F.sum("n"), "keyed": F.sum("k"), "quantity": F.sum("q").cast("decimal(38,9)"), "first_received": F.min("a"), "last_received": F.max("z")}
    return _plain(skew_aggregate(rows, "tenant_id", partial, final))


def p4_above_stored_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant: deliveries whose quantity exceeds the tenant's mean of stored usage, by a join on the skewed key."""
    stored = table(spark, sf_dir, "stored_events").groupBy("tenant_id").agg(F.sum("quantity").alias("s"), F.count("quantity").alias("c"))
    rows = _usage(spark, sf_dir).select("tenant_id", as_decimal().alias("q"))
    joined = skew_join(rows, stored, "tenant_id").withColumn("above", F.coalesce(F.col("q") * F.col("c") > F.col("s"), F.lit(False)).cast("bigint"))
    return skew_aggregate(joined.select("tenant_id", "above", "c"), "tenant_id", {"n": F.count(F.lit(1)), "a": F.sum("above"), "c": F.max("c")}, {"deliveries": F.sum("n"), "above_mean": F.sum("a"), "stored_rows": F.coalesce(F.max("c"), F.lit(0))})


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling(counted(_usage(spark, sf_dir)), ["tenant_id", "meter"], F.to_date("occurred_at"), F.col("quantity"), LAST_DAY)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the last 7 days hold nothing and the last 30 something."""
    return _rolling(spark, sf_dir).where("total_7 = 0 and total_30 > 0").select("tenant_id", "meter", F.date_format("usage_day", "yyyy-MM-dd").alias("usage_day"))


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of the last 7 and 30 days for every tenant, meter and day."""
    return _plain(_rolling(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p2_upserts, p2_daily_usage, p2_diverted, p2_stream, p4_found, p4_tenant_totals, p4_above_stored_mean, p5_found, p5_rolling)}

_KEPT = """kept as (select * from (select *, row_number() over (partition by tenant_id, idempotency_key order by received_at, log_offset) as copy
  from usage_events where idempotency_key <> '') where copy = 1)"""
_PLAIN = r"regexp_full_match(quantity, '0*[0-9]{1,29}(\.[0-9]{1,9})?')"
_COUNTED = f"""{_KEPT}, counted as (select *, cast(quantity as decimal(38,9)) as q, cast(make_timestamp(epoch_us(occurred_at)) as date) as od, cast(make_timestamp(epoch_us(received_at)) as date) as rd from kept
  where meter is not null and occurred_at is not null and {_PLAIN}
  and epoch_us(occurred_at) between epoch_us(received_at) - 3024000000000 and epoch_us(received_at) + 300000000)"""
_UPSERTS = f"""{_COUNTED}, per as (select tenant_id, meter, od as usage_day, rd as arrival_day, sum(q) as s, count(*) as n, count(*) filter (rd > od) as c from counted group by all),
ups as (select tenant_id, meter, usage_day, row_number() over w as version, arrival_day, cast(sum(s) over w as decimal(38,9)) as quantity, cast(sum(n) over w as bigint) as events,
  cast(sum(c) over w as bigint) as corrections from per window w as (partition by tenant_id, meter, usage_day order by arrival_day rows between unbounded preceding and current row))"""
_ROLLING = f"""{_COUNTED}, per as (select tenant_id, meter, od, sum(q) as s from counted where od <= date '2026-08-03' group by all),
series as (select tenant_id, meter, min(od) as first_day from per group by all),
days as (select tenant_id, meter, cast(unnest(generate_series(first_day, date '2026-08-03', interval 1 day)) as date) as usage_day from series),
roll as (select d.tenant_id, d.meter, d.usage_day, cast(coalesce(p.s, 0) as decimal(38,9)) as quantity,
  cast(sum(coalesce(p.s, 0)) over (partition by d.tenant_id, d.meter order by d.usage_day rows between 6 preceding and current row) as decimal(38,9)) as total_7,
  cast(sum(coalesce(p.s, 0)) over (partition by d.tenant_id, d.meter order by d.usage_day rows between 29 preceding and current row) as decimal(38,9)) as total_30
  from days d left join per p on p.tenant_id is not distinct from d.tenant_id and p.meter = d.meter and p.od = d.usage_day)"""

#: DuckDB's DECIMAL division goes through DOUBLE, so averages are divided as whole billionths, rounded half up.
_AVERAGE = "cast(cast(cast((cast(cast(total_{0} as decimal(28,9)) * 1000000000 as hugeint) * 2 + {0}) // (2 * {0}) as decimal(28,0)) * 0.000000001 as decimal(38,9)) as varchar) as average_{0}"

_DAY, _TEXT = "strftime({0}, '%Y-%m-%d') as {0}", "cast({0} as varchar) as {0}"

ORACLE = {
    "p1_found": "select log_offset from (select log_offset, row_number() over (partition by tenant_id, idempotency_key order by received_at, log_offset) as copy from usage_events where idempotency_key <> '') where copy > 1",
    "p1_kept": f"with {_KEPT} select log_offset, tenant_id, idempotency_key, epoch_us(received_at) as received_at from kept",
    "p2_found": f"with {_COUNTED} select log_offset from counted where rd > od",
    "p2_upserts": f"with {_UPSERTS} select * replace ({_DAY.format('usage_day')}, {_DAY.format('arrival_day')}, {_TEXT.format('quantity')}) from ups",
    "p2_daily_usage": f"with {_UPSERTS} select tenant_id, meter, {_DAY.format('usage_day')}, version, {_TEXT.format('quantity')}, events, corrections from ups qualify row_number() over (partition by tenant_id, meter, usage_day order by version desc) = 1",
    "p2_stream": f"with {_COUNTED} select tenant_id, meter, strftime(od, '%Y-%m-%d') as usage_day, cast(cast(sum(q) as decimal(38,9)) as varchar) as quantity, count(*) as events from counted group by tenant_id, meter, od",
    "p2_diverted": f"""select * from (select log_offset, case when coalesce(idempotency_key, '') = '' then 'no_key' when meter is null then 'no_meter' when occurred_at is null then 'no_time'
      when not coalesce({_PLAIN}, false) then 'bad_quantity' when epoch_us(occurred_at) < epoch_us(received_at) - 3024000000000 then 'too_late'
      when epoch_us(occurred_at) > epoch_us(received_at) + 300000000 then 'too_early' end as reason, tenant_id, meter, epoch_us(occurred_at) as occurred_at, epoch_us(received_at) as received_at from usage_events) where reason is not null""",
    "p4_found": "select tenant_id from usage_events group by tenant_id having count(*) * 50 >= (select count(*) from usage_events)",
    "p4_tenant_totals": f"""select tenant_id, count(*) as deliveries, count(*) filter (idempotency_key <> '') as keyed,
      cast(cast(sum(case when {_PLAIN} then cast(quantity as decimal(38,9)) end) as decimal(38,9)) as varchar) as quantity, epoch_us(min(received_at)) as first_received, epoch_us(max(received_at)) as last_received from usage_events group by tenant_id""",
    "p4_above_stored_mean": f"""with m as (select tenant_id as t, sum(quantity) as s, count(quantity) as c from stored_events group by 1),
      u as (select tenant_id, case when {_PLAIN} then cast(quantity as decimal(38,9)) end as q from usage_events)
      select tenant_id, count(*) as deliveries, count(*) filter (cast(q as decimal(30,9)) * c > s) as above_mean, coalesce(max(c), 0) as stored_rows from u left join m on t = tenant_id group by tenant_id""",
    "p5_found": f"with {_ROLLING} select tenant_id, meter, strftime(usage_day, '%Y-%m-%d') as usage_day from roll where total_7 = 0 and total_30 > 0",
    "p5_rolling": f"with {_ROLLING} select tenant_id, meter, {_DAY.format('usage_day')}, {_TEXT.format('quantity')}, {_TEXT.format('total_7')}, {_AVERAGE.format(7)}, {_TEXT.format('total_30')}, {_AVERAGE.format(30)} from roll",
}
