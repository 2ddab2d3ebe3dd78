"""Queries of the event log itself: validation, fingerprints, classification, offsets, usage and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.fingerprint import fingerprint, rfc3339_instant, rfc3339_nano, rfc3339_text_in_utc
from tallymill.functions.keys import has_key
from tallymill.functions.quantity import canonical, is_plain
from tallymill.functions.validation import rejection
from tallymill.operators.classify import classify
from tallymill.operators.counted import counted, verdict
from tallymill.operators.offsets import as_of, consumer_lag, high_water_mark, latest_cursors, offset_range, segments
from tallymill.operators.skew import skew_aggregate
from tallymill.sources.requests import decode_event, encode_event, parse_bodies
from tallymill.sources.tables import table

SEGMENT_RECORDS = 1000
INDEX_EVERY = 64


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_events")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_usage(spark, sf_dir), table(spark, sf_dir, "stored_events"))


def _text(amount: Column) -> Column:
    return amount.cast("decimal(38,9)").cast("string")


# validation and projection


def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, code and detail of every request."""
    judged = table(spark, sf_dir, "ingest_requests").withColumn("r", rejection(F.col("received_at")))
    return judged.select("request_id", F.coalesce("r.status", F.lit(202)).alias("status"), F.coalesce("r.code", F.lit("accepted")).alias("code"), F.coalesce("r.detail", F.lit("")).alias("detail"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per status and code."""
    return validate_verdicts(spark, sf_dir).groupBy("status", "code").agg(F.count(F.lit(1)).alias("requests"))


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as JSON bodies, decoded strictly and judged again."""
    names = ["tenant_id", "meter", "quantity", "occurred_at", "idempotency_key"]
    bodies = table(spark, sf_dir, "ingest_requests").select("request_id", "received_at", F.to_json(F.struct(*names)).alias("body"))
    return parse_bodies(bodies).select("request_id", F.coalesce("rejected.status", F.lit(202)).alias("status"), F.coalesce("rejected.code", F.lit("accepted")).alias("code"))


def canonical_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plain quantity without the zeros that don't change it."""
    return _usage(spark, sf_dir).where(is_plain()).select("log_offset", canonical(F.col("quantity")).alias("canonical"))


def fingerprint_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint computed from each row's content."""
    rows = _usage(spark, sf_dir).where(is_plain() & F.col("tenant_id").isNotNull() & F.col("meter").isNotNull() & F.col("occurred_at").isNotNull())
    return rows.select("log_offset", F.lower(F.hex(fingerprint(F.col("tenant_id"), F.col("meter"), F.col("quantity"), rfc3339_nano(F.col("occurred_at"))))).alias("fingerprint"))


def fingerprint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: delivered fingerprints that could be compared with their row's content, those it doesn't give, and rows that came without one."""
    rows = _usage(spark, sf_dir).where(is_plain() & F.col("tenant_id").isNotNull() & F.col("meter").isNotNull() & F.col("occurred_at").isNotNull())
    computed = fingerprint(F.col("tenant_id"), F.col("meter"), F.col("quantity"), rfc3339_nano(F.col("occurred_at")))
    return rows.agg(F.count("fingerprint").alias("compared"), F.count(F.when(F.col("fingerprint") != computed, 1)).alias("mismatches"), F.count(F.when(F.col("fingerprint").isNull(), 1)).alias("missing"))


def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of acceptable requests, from the raw time text, so nanoseconds count."""
    good = table(spark, sf_dir, "ingest_requests").where(rejection(F.col("received_at")).isNull())
    return good.select("request_id", F.lower(F.hex(fingerprint(F.col("tenant_id"), F.col("meter"), F.col("quantity"), rfc3339_text_in_utc(F.col("occurred_at"))))).alias("fingerprint"))


def event_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event after encoding and strict decoding."""
    back = _usage(spark, sf_dir).select("log_offset", decode_event(encode_event()).alias("e")).select("log_offset", "e.*")
    return back.withColumns({"occurred_at": F.unix_micros("occurred_at"), "received_at": F.unix_micros("received_at"), "fingerprint": F.lower(F.hex("fingerprint"))})


# classification


def classify_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyed delivery as inserted, duplicate or conflict, given what was stored before."""
    return _classified(spark, sf_dir).select("log_offset", "outcome")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries per outcome."""
    return _classified(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("deliveries"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drain of the log into an empty table stores."""
    return classify(_usage(spark, sf_dir)).where("outcome = 'inserted'").select("log_offset", "tenant_id", "idempotency_key", "meter", "quantity")


def key_reuse_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys reused for other content, with both fingerprints."""
    rows = _classified(spark, sf_dir).where("outcome = 'conflict'")
    return rows.select("log_offset", "tenant_id", "idempotency_key", F.lower("first_fingerprint").alias("first_fingerprint"), F.lower(F.hex("fingerprint")).alias("offered_fingerprint"))


def ingest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to every request, given stored rows, the log and earlier accepted requests: 202, 400, 409 or 422."""
    requests = table(spark, sf_dir, "ingest_requests").withColumn("r", rejection(F.col("received_at")))
    refused = requests.where("r is not null").select("request_id", "r.status", "r.code", F.lit(False).alias("duplicate"))
    text = rfc3339_text_in_utc(F.col("occurred_at"))
    offered = requests.where("r is null").select(F.col("request_id").alias("log_offset"), "tenant_id", "idempotency_key", fingerprint(F.col("tenant_id"), F.col("meter"), F.col("quantity"), text).alias("fingerprint"))
    stored = table(spark, sf_dir, "stored_events").select("tenant_id", "idempotency_key", "payload_fingerprint", F.lit(0).cast("bigint").alias("rank"))
    log = _usage(spark, sf_dir).select("tenant_id", "idempotency_key", F.col("fingerprint").alias("payload_fingerprint"), (F.col("log_offset") + 1).alias("rank"))
    answered = classify(offered, stored.unionByName(log))
    conflict = F.col("outcome") == "conflict"
    accepted = answered.select(F.col("log_offset").alias("request_id"), F.when(conflict, 409).otherwise(202).alias("status"), F.when(conflict, "idempotency_key_reuse").otherwise("accepted").alias("code"), (F.col("outcome") == "duplicate").alias("duplicate"))
    return refused.unionByName(accepted)


def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that reach no total: unusable rows with their reason, and conflicts."""
    unusable = _usage(spark, sf_dir).withColumn("reason", verdict()).where("reason is not null").select("log_offset", "reason", "tenant_id", "idempotency_key")
    conflicts = _classified(spark, sf_dir).where((F.col("outcome") == "conflict") & verdict().isNull()).select("log_offset", F.lit("key_reuse").alias("reason"), "tenant_id", "idempotency_key")
    return unusable.unionByName(conflicts)


# lateness and usage


def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds from occurrence to arrival."""
    return _usage(spark, sf_dir).where("occurred_at is not null").select("log_offset", (F.unix_micros("received_at") - F.unix_micros("occurred_at")).alias("lateness_us"))


def late_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries per bucket of lateness."""
    late = F.col("lateness_us")
    bucket = F.when(late < 0, "early").when(late <= 60_000_000, "minute").when(late <= 3_600_000_000, "hour").when(late <= 86_400_000_000, "day").when(late <= 7 * 86_400_000_000, "week").when(late <= 35 * 86_400_000_000, "in_time").otherwise("too_late")
    return lateness(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("deliveries"), F.min("lateness_us").alias("least_us"), F.max("lateness_us").alias("most_us"))


def tenant_period_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage per tenant, meter and calendar month; tenants of any size by split and salted aggregation."""
    rows = counted(_usage(spark, sf_dir)).select("tenant_id", "meter", F.date_format("occurred_at", "yyyy-MM").alias("period"), "quantity")
    partial = {"n": F.count(F.lit(1)), "q": F.sum("quantity")}
    return skew_aggregate(rows, ["tenant_id", "meter", "period"], partial, {"events": F.sum("n"), "quantity": _text(F.sum("q"))})


def meter_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage per meter and day."""
    rows = counted(_usage(spark, sf_dir)).groupBy("meter", F.date_format("occurred_at", "yyyy-MM-dd").alias("usage_day"))
    return rows.agg(F.count(F.lit(1)).alias("events"), _text(F.sum("quantity")).alias("quantity"))


# offsets


def offset_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth tenth of the log by offset, as one batch of a consumer reads it."""
    log = _usage(spark, sf_dir)
    end = high_water_mark(log).first()[0]
    return offset_range(log, end * 9 // 10, end).select("log_offset", "tenant_id", "meter", "quantity")


def log_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next offset of the log."""
    return high_water_mark(_usage(spark, sf_dir))


def consumer_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last committed cursor of each consumer."""
    return latest_cursors(table(spark, sf_dir, "consumer_offsets")).select("consumer", "next_offset")


def consumer_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each consumer is behind."""
    return consumer_lag(table(spark, sf_dir, "consumer_offsets"), _usage(spark, sf_dir))


def segment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into segments of a thousand records."""
    return segments(_usage(spark, sf_dir), SEGMENT_RECORDS)


def sparse_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record the last index entry at or before it in its segment: entries are every 64th offset of a segment."""
    base = (F.floor(F.col("log_offset") / SEGMENT_RECORDS) * SEGMENT_RECORDS).cast("bigint")
    log = _usage(spark, sf_dir).select("log_offset", base.alias("base_offset"))
    entries = log.where((F.col("log_offset") - F.col("base_offset")) % INDEX_EVERY == 0).withColumn("entry_offset", F.col("log_offset"))
    return as_of(log, entries, "base_offset", "log_offset", "entry_offset").select("log_offset", "base_offset", "entry_offset")


# invariants


def replay_is_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what a second drain of the whole log would insert on top of the first, and what it would find again."""
    log = _usage(spark, sf_dir)
    first = classify(log).where("outcome = 'inserted'").withColumnRenamed("fingerprint", "payload_fingerprint")
    again = classify(log, first.select("tenant_id", "idempotency_key", "payload_fingerprint"))
    of = lambda outcome: F.count(F.when(F.col("outcome") == outcome, 1))
    return again.agg(of("inserted").alias("inserted"), of("duplicate").alias("duplicates"), of("conflict").alias("conflicts"))


def invariant_one_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: keys, inserted deliveries, and keys with more than one of them."""
    per = classify(_usage(spark, sf_dir)).groupBy("tenant_id", "idempotency_key").agg(F.count(F.when(F.col("outcome") == "inserted", 1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("inserted"), F.count(F.when(F.col("n") != 1, 1)).alias("violations"))


def invariant_nothing_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: deliveries, those that are classified, those without key, and those that are neither."""
    log = _usage(spark, sf_dir)
    seen = classify(log).select("log_offset", F.lit("classified").alias("as")).unionByName(log.where(~has_key()).select("log_offset", F.lit("keyless").alias("as")))
    of = lambda what: F.count(F.when(F.col("as") == what, 1))
    return log.select("log_offset").join(seen, "log_offset", "left").agg(F.count(F.lit(1)).alias("deliveries"), of("classified").alias("classified"), of("keyless").alias("keyless"), F.count(F.when(F.col("as").isNull(), 1)).alias("lost"))


QUERIES = {
    f.__name__: f
    for f in (
        validate_verdicts, verdict_counts, request_bodies, canonical_quantity, fingerprint_hex, fingerprint_check, request_fingerprints, event_codec,
        classify_outcomes, outcome_counts, dedup_first_wins, key_reuse_conflicts, ingest_responses, dead_letter, lateness, late_by_bucket, tenant_period_usage, meter_usage_daily,
        offset_range_scan, log_end, consumer_cursors, consumer_lags, segment_assignment, sparse_index_lookup, replay_is_noop, invariant_one_event_per_key, invariant_nothing_lost,
    )
}

_PLAIN = r"regexp_full_match(quantity, '0*[0-9]{1,29}(\.[0-9]{1,9})?')"
_CANONICAL = r"regexp_replace(regexp_replace(regexp_replace(quantity, '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
_PREFIXED = "unhex(printf('%016x', octet_length(encode({0})))) || encode({0})"
_NANO = r"regexp_replace(strftime(make_timestamp(epoch_us({0})), '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z'"


def _sha(time_text: str) -> str:
    fields = ["tenant_id", "meter", _CANONICAL, time_text]
    return "sha256(" + " || ".join(_PREFIXED.format(f"({x})") for x in fields) + ")"


_ROW_OK = f"{_PLAIN} and tenant_id is not null and meter is not null and occurred_at is not null"
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIME_OK = r"regexp_full_match(occurred_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})')"


def _string_cases(c: str) -> str:
    return f"""when coalesce({c}, '') = '' then '400|invalid_field|{c} is required'
      when octet_length(encode({c})) > 255 then '400|invalid_field|{c} must be at most 255 bytes'
      when regexp_matches({c}, '^{_SPACE}|{_SPACE}$') then '400|invalid_field|{c} must not have leading or trailing whitespace' """


_VERDICT = f"""judged as (select *, case when occurred_at is not null and t is null then '400|malformed_request|occurred_at is not an RFC 3339 time'
      {_string_cases("tenant_id")} {_string_cases("meter")} {_string_cases("idempotency_key")}
      when coalesce(quantity, '') = '' then '400|invalid_field|quantity is required'
      when regexp_matches(quantity, '[eE]') then '400|invalid_field|quantity must not use scientific notation'
      when quantity[1] = '-' then '400|invalid_field|quantity must not be negative'
      when quantity[1] = '+' then '400|invalid_field|quantity must not have a leading plus sign'
      when quantity[1] = '.' then '400|invalid_field|quantity must have at least one digit before the decimal point'
      when regexp_full_match(quantity, '[^.]*\\.') then '400|invalid_field|quantity must have at least one digit after the decimal point'
      when not regexp_full_match(quantity, '[0-9]+(\\.[0-9]+)?') then '400|invalid_field|quantity must be a decimal number'
      when length(ltrim(split_part(quantity, '.', 1), '0')) > 29 then '400|invalid_field|quantity must have at most 29 digits before the decimal point'
      when length(split_part(quantity, '.', 2)) > 9 then '400|invalid_field|quantity must have at most 9 digits after the decimal point'
      when t is null or t = epoch_us(timestamp '0001-01-01 00:00:00') then '400|invalid_field|occurred_at is required'
      when t > epoch_us(received_at) + 300000000 then '400|invalid_field|occurred_at must not be in the future'
      when t < epoch_us(received_at) - 3024000000000 then '422|event_too_old|occurred_at is more than 35 days old; use the backfill path'
      else '202|accepted|' end as v from (select *, case when {_TIME_OK} then epoch_us(try_cast(occurred_at as timestamptz)) end as t from ingest_requests))"""
_RAW_NANO = r"strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S') || case when regexp_replace(regexp_extract(occurred_at, '\.([0-9]+)', 1), '0+$', '') = '' then '' else '.' || regexp_replace(regexp_extract(occurred_at, '\.([0-9]+)', 1), '0+$', '') end || 'Z'"


def _classify(log: str, stored: str | None, offset: str = "log_offset") -> str:
    """Common table expressions that end in ``classified``: the log's rows with outcome and ff, the first fingerprint."""
    rows = f"select tenant_id as t, idempotency_key as k, {offset} as o, fingerprint as f from {log} where idempotency_key <> ''"
    if stored:
        rows += f" union all select tenant_id, idempotency_key, -1, payload_fingerprint from {stored} where idempotency_key <> ''"
    return f"""firsts as (select t, k, o as fo, f as ff from ({rows}) qualify row_number() over (partition by t, k order by o) = 1),
      classified as (select l.*, ff, case when {offset} = fo then 'inserted' when ff is null or fingerprint is not distinct from ff then 'duplicate' else 'conflict' end as outcome
        from {log} l join firsts on t is not distinct from l.tenant_id and k = l.idempotency_key)"""


_KEPT = """kept as (select * from usage_events where idempotency_key <> '' qualify row_number() over (partition by tenant_id, idempotency_key order by received_at, log_offset) = 1)"""
_IN_TIME = "epoch_us(occurred_at) between epoch_us(received_at) - 3024000000000 and epoch_us(received_at) + 300000000"
_COUNTED = f"""{_KEPT}, counted as (select *, cast(quantity as decimal(38,9)) as q, make_timestamp(epoch_us(occurred_at)) as utc from kept where meter is not null and occurred_at is not null and {_PLAIN} and {_IN_TIME})"""
_REASON = f"""case when coalesce(idempotency_key, '') = '' then 'no_key' when meter is null then 'no_meter' when occurred_at is null then 'no_time' when not coalesce({_PLAIN}, false) then 'bad_quantity'
      when epoch_us(occurred_at) < epoch_us(received_at) - 3024000000000 then 'too_late' when epoch_us(occurred_at) > epoch_us(received_at) + 300000000 then 'too_early' end"""
_LATENESS = "select log_offset, epoch_us(received_at) - epoch_us(occurred_at) as lateness_us from usage_events where occurred_at is not null"

ORACLE = {
    "validate_verdicts": f"with {_VERDICT} select request_id, cast(split_part(v, '|', 1) as int) as status, split_part(v, '|', 2) as code, split_part(v, '|', 3) as detail from judged",
    "verdict_counts": f"with {_VERDICT} select cast(split_part(v, '|', 1) as int) as status, split_part(v, '|', 2) as code, count(*) as requests from judged group by all",
    "request_bodies": f"with {_VERDICT} select request_id, cast(split_part(v, '|', 1) as int) as status, split_part(v, '|', 2) as code from judged",
    "canonical_quantity": f"select log_offset, {_CANONICAL} as canonical from usage_events where {_PLAIN}",
    "fingerprint_hex": f"select log_offset, {_sha(_NANO.format('occurred_at'))} as fingerprint from usage_events where {_ROW_OK}",
    "fingerprint_check": f"select count(fingerprint) as compared, count(*) filter (lower(hex(fingerprint)) <> {_sha(_NANO.format('occurred_at'))}) as mismatches, count(*) filter (fingerprint is null) as missing from usage_events where {_ROW_OK}",
    "request_fingerprints": f"with {_VERDICT} select request_id, {_sha(_RAW_NANO)} as fingerprint from judged where v = '202|accepted|'",
    "event_codec": "select log_offset, tenant_id, meter, quantity, epoch_us(occurred_at) as occurred_at, epoch_us(received_at) as received_at, idempotency_key, lower(hex(fingerprint)) as fingerprint from usage_events",
    "classify_outcomes": f"with {_classify('usage_events', 'stored_events')} select log_offset, outcome from classified",
    "outcome_counts": f"with {_classify('usage_events', 'stored_events')} select outcome, count(*) as deliveries from classified group by outcome",
    "dedup_first_wins": f"with {_classify('usage_events', None)} select log_offset, tenant_id, idempotency_key, meter, quantity from classified where outcome = 'inserted'",
    "key_reuse_conflicts": f"with {_classify('usage_events', 'stored_events')} select log_offset, tenant_id, idempotency_key, lower(hex(ff)) as first_fingerprint, lower(hex(fingerprint)) as offered_fingerprint from classified where outcome = 'conflict'",
    "ingest_responses": f"""with {_VERDICT}, offered as (select request_id, tenant_id, idempotency_key, unhex({_sha(_RAW_NANO)}) as fingerprint from judged where v = '202|accepted|'),
      drained as (select * from usage_events where idempotency_key <> '' qualify row_number() over (partition by tenant_id, idempotency_key order by log_offset) = 1),
      before as (select tenant_id, idempotency_key, payload_fingerprint from stored_events union all select d.tenant_id, d.idempotency_key, d.fingerprint from drained d
        where not exists (select 1 from stored_events s where s.tenant_id = d.tenant_id and s.idempotency_key = d.idempotency_key)),
      {_classify("offered", "before", "request_id")}
      select request_id, case when outcome = 'conflict' then 409 else 202 end as status, case when outcome = 'conflict' then 'idempotency_key_reuse' else 'accepted' end as code, outcome = 'duplicate' as duplicate from classified
      union all select request_id, cast(split_part(v, '|', 1) as int), split_part(v, '|', 2), false from judged where v <> '202|accepted|'""",
    "dead_letter": f"""with {_classify("usage_events", "stored_events")} select log_offset, {_REASON} as reason, tenant_id, idempotency_key from usage_events where {_REASON} is not null
      union all select log_offset, 'key_reuse', tenant_id, idempotency_key from classified where outcome = 'conflict' and {_REASON} is null""",
    "lateness": _LATENESS,
    "late_by_bucket": f"""select case when lateness_us < 0 then 'early' when lateness_us <= 60000000 then 'minute' when lateness_us <= 3600000000 then 'hour' when lateness_us <= 86400000000 then 'day'
      when lateness_us <= 604800000000 then 'week' when lateness_us <= 3024000000000 then 'in_time' else 'too_late' end as bucket, count(*) as deliveries, min(lateness_us) as least_us, max(lateness_us) as most_us from ({_LATENESS}) group by 1""",
    "tenant_period_usage": f"with {_COUNTED} select tenant_id, meter, strftime(utc, '%Y-%m') as period, count(*) as events, cast(cast(sum(q) as decimal(38,9)) as varchar) as quantity from counted group by all",
    "meter_usage_daily": f"with {_COUNTED} select meter, strftime(utc, '%Y-%m-%d') as usage_day, count(*) as events, cast(cast(sum(q) as decimal(38,9)) as varchar) as quantity from counted group by all",
    "offset_range_scan": "select log_offset, tenant_id, meter, quantity from usage_events where log_offset >= (select (max(log_offset) + 1) * 9 // 10 from usage_events)",
    "log_end": "select coalesce(max(log_offset), -1) + 1 as next_offset from usage_events",
    "consumer_cursors": "select consumer, next_offset from consumer_offsets qualify row_number() over (partition by consumer order by updated_at desc, next_offset desc) = 1",
    "consumer_lags": "select consumer, next_offset, e as log_end, greatest(0, e - next_offset) as lag from consumer_offsets, (select max(log_offset) + 1 as e from usage_events)",
    "segment_assignment": f"select log_offset // {SEGMENT_RECORDS} * {SEGMENT_RECORDS} as base_offset, count(*) as records, min(log_offset) as first_offset, max(log_offset) as last_offset, printf('%020d.log', log_offset // {SEGMENT_RECORDS} * {SEGMENT_RECORDS}) as segment from usage_events group by 1, 5",
    "sparse_index_lookup": f"select log_offset, log_offset // {SEGMENT_RECORDS} * {SEGMENT_RECORDS} as base_offset, log_offset - (log_offset % {SEGMENT_RECORDS}) % {INDEX_EVERY} as entry_offset from usage_events",
    "replay_is_noop": f"with {_classify('usage_events', None)} select 0 as inserted, count(*) filter (outcome <> 'conflict') as duplicates, count(*) filter (outcome = 'conflict') as conflicts from classified",
    "invariant_one_event_per_key": "select count(*) as keys, count(*) as inserted, 0 as violations from (select distinct tenant_id, idempotency_key from usage_events where idempotency_key <> '')",
    "invariant_nothing_lost": "select count(*) as deliveries, count(*) filter (idempotency_key <> '') as classified, count(*) filter (coalesce(idempotency_key, '') = '') as keyless, 0 as lost from usage_events",
}
