"""Queries that run the consumer and the segmented log themselves: the delivery log is written as segments, read back, cut, resumed and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.counted import verdict
from tallymill.session import scratch
from tallymill.plans.event_log import _REASON
from tallymill.sources import log_segments
from tallymill.sources.requests import decode_event, encode_event, parse_bodies
from tallymill.sources.tables import table
from tallymill.streaming.drain import Consumer, Stats

#: Bytes of a segment, small enough that the tables here have several.
SEGMENT_BYTES = 4 * 1024 * 1024
BATCHES = 3
SKEWS = (-24, -3, 0, 3, 24)


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    log = table(spark, sf_dir, "usage_events")
    return log, (log.agg(F.max("log_offset")).first()[0] or -1) + 1


def _cuts(end: int, batches: int) -> list[int]:
    return [end * k // batches for k in range(batches + 1)]


def _consumer(spark: SparkSession, name: str = "usage", home: str | None = None) -> Consumer:
    return Consumer(spark, home or scratch(spark, "consumer"), name, on_poison="quarantine")


def _segments(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, int]:
    """The delivery log as segments, a task each part of them."""
    log, end = _log(spark, sf_dir)
    folder = scratch(spark, "segments")
    log_segments.write_table(log.select("log_offset", encode_event().cast("binary").alias("payload")), folder, spark.sparkContext.defaultParallelism, SEGMENT_BYTES)
    log_segments.register(spark)
    return folder, spark.read.format("segmented_log").load(folder), end


def _decoded(records: DataFrame) -> DataFrame:
    """The events of log records, instants as microseconds and fingerprints as hex."""
    rows = records.select("log_offset", decode_event(F.col("payload").cast("string")).alias("e")).select("log_offset", "e.*")
    return rows.withColumns({"occurred_at": F.unix_micros("occurred_at"), "received_at": F.unix_micros("received_at"), "fingerprint": F.lower(F.hex("fingerprint"))})


def drain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drain in three batches stores and what it puts aside, with the reason; rows it neither stores nor lists are duplicates."""
    log, end = _log(spark, sf_dir)
    consumer = _consumer(spark)
    consumer.drain_table(log, _cuts(end, BATCHES))
    stored = consumer.rows().select(F.col("id").alias("log_offset"), F.lit("inserted").alias("outcome"))
    return stored.unionByName(consumer.dead_letters().select("log_offset", F.col("reason").alias("outcome")))


def drain_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what reading the whole log once more does after it was drained."""
    log, end = _log(spark, sf_dir)
    consumer = _consumer(spark)
    consumer.drain_table(log, _cuts(end, BATCHES))
    again = consumer.apply(log)
    return spark.createDataFrame([(again.read, again.inserted, again.duplicates, again.conflicts, consumer.next_offset())], "read bigint, inserted bigint, duplicates bigint, conflicts bigint, next_offset bigint")


class _Killed(Consumer):
    """A consumer that dies when it is about to publish."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self._commits.publish = self._die

    def _die(self, *_) -> bool:
        raise InterruptedError


def drain_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows stored when a consumer is killed in its second batch and another goes on with batches cut otherwise, which overlap the first."""
    log, end = _log(spark, sf_dir)
    home = scratch(spark, "consumer")
    _consumer(spark, home=home).drain_table(log, [0, end // 2])
    try:
        _Killed(spark, home, "usage", on_poison="quarantine").drain_table(log, [end // 2, end])
    except InterruptedError:
        pass
    consumer = _consumer(spark, home=home)
    consumer.drain_table(log, [end // 4, end * 2 // 3, end])
    return consumer.rows().select("id", "tenant_id", "idempotency_key", "meter", F.col("quantity").cast("string").alias("quantity"))


def drain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two consumers of one log stand, and what they have stored: the first has read all, the second half."""
    log, end = _log(spark, sf_dir)
    home = scratch(spark, "consumer")
    out = None
    for name, upto in (("all", end), ("half", end // 2)):
        consumer = _consumer(spark, name, home)
        consumer.drain_table(log, [0, upto])
        at = consumer.rows().agg(F.lit(name).alias("consumer"), F.lit(consumer.next_offset()).alias("next_offset"), F.count(F.lit(1)).alias("stored"))
        out = at if out is None else out.unionAll(at)
    return out


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as it comes back from the segmented log: framed, checked and decoded."""
    return _decoded(_segments(spark, sf_dir)[1])


def log_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of the segmented log, from the index entry before it on."""
    _, records, end = _segments(spark, sf_dir)
    return _decoded(records.where(F.col("log_offset") >= end * 9 // 10)).select("log_offset", "tenant_id", "idempotency_key")


def log_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record at which each consumer stands, read by its offset through the segment's index."""
    folder, _, _ = _segments(spark, sf_dir)
    cursors = table(spark, sf_dir, "consumer_offsets").select("consumer", "next_offset")
    found = _decoded(log_segments.read_at(cursors.select(F.col("next_offset").alias("log_offset")).distinct(), folder))
    return cursors.join(found, F.col("next_offset") == F.col("log_offset")).select("consumer", "next_offset", "tenant_id", "idempotency_key", "quantity")


def log_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a crash in its last record, recovered and written on: the lost record is the one that is written again."""
    folder, records, end = _segments(spark, sf_dir)
    _, last = log_segments.list_segments(folder)[-1]
    log_segments._write(last, log_segments._read(last)[:-3])
    torn = log_segments.log_end(folder)
    payload = _log(spark, sf_dir)[0].where(F.col("log_offset") == end - 1).select(encode_event().cast("binary")).first()[0]
    log_segments.write_log(folder, [bytes(payload)], SEGMENT_BYTES, base=torn)
    return _decoded(records).select("log_offset", F.lit(torn).cast("bigint").alias("torn_end"), "tenant_id", "idempotency_key")


def fault_every_message_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: a drain of a log in which every delivery comes a second time later on; nothing more is stored than without."""
    log, end = _log(spark, sf_dir)
    twice = log.unionByName(log.withColumn("log_offset", F.col("log_offset") + end))
    total = Stats()
    for stats in _consumer(spark).drain_table(twice, _cuts(2 * end, 4)):
        total.add(stats)
    return spark.createDataFrame([(total.read, total.inserted, total.duplicates, total.conflicts)], "read bigint, inserted bigint, duplicates bigint, conflicts bigint")


def fault_clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries per verdict when the clients' clocks are off by so many hours."""
    rows = _log(spark, sf_dir)[0].withColumn("skew_hours", F.explode(F.array(*[F.lit(h) for h in SKEWS])))
    judged = rows.withColumn("occurred_at", F.timestamp_micros(F.unix_micros("occurred_at") + F.col("skew_hours").cast("bigint") * 3_600_000_000)).withColumn("verdict", F.coalesce(verdict(), F.lit("usable")))
    return judged.groupBy("skew_hours", "verdict").agg(F.count(F.lit(1)).alias("deliveries"))


def body_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to request bodies that are cut off, too large, not an object, or have a field too many or of another type."""
    names = ["tenant_id", "meter", "quantity", "occurred_at", "idempotency_key"]
    body = F.to_json(F.struct(*names))
    kinds = {
        "cut": F.expr("left(body, length(body) div 2)"),
        "large": F.concat("body", F.expr("repeat(' ', 65536)")),
        "array": F.concat(F.lit("["), "body", F.lit("]")),
        "misspelled": F.concat(F.lit('{"quanity":"1",'), F.expr("substring(body, 2)")),
        "number": F.concat(F.lit('{"quantity":1'), F.when(F.length("body") > 2, ",").otherwise(""), F.expr("substring(body, 2)")),
        "empty": F.lit(""),
    }
    requests = table(spark, sf_dir, "ingest_requests").select("request_id", "received_at", body.alias("body"))
    out = None
    for kind, made in kinds.items():
        part = parse_bodies(requests.withColumn("body", made))
        counted = part.groupBy(F.coalesce("rejected.status", F.lit(202)).alias("status"), F.coalesce("rejected.code", F.lit("accepted")).alias("code")).agg(F.count(F.lit(1)).alias("requests")).withColumn("kind", F.lit(kind))
        out = counted if out is None else out.unionByName(counted)
    return out


def segmented_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: a drain of the segmented log, with what it read and stored."""
    folder, _, end = _segments(spark, sf_dir)
    s = _consumer(spark).drain_segments(folder, max(1, -(-end // BATCHES)))
    return spark.createDataFrame([(s.read, s.inserted, s.duplicates, s.conflicts)], "read bigint, inserted bigint, duplicates bigint, conflicts bigint")


QUERIES = {f.__name__: f for f in (drain_outcomes, drain_replay, drain_resume, drain_positions, log_roundtrip, log_range_read, log_point_read, log_torn_tail, segmented_drain, fault_every_message_twice, fault_clock_skew, body_faults)}


def _drained(upto: str = "true") -> str:
    """Common table expressions: usable rows, their outcomes, and the rows put aside as unusable, with the reason."""
    return f"""u as (select *, case when regexp_full_match(quantity, '[\\x00-\\x7F]*') then try_cast(quantity as decimal(38,9)) end as q from usage_events where {upto}),
      usable as (select * from u where idempotency_key <> '' and q is not null),
      o as (select *, first_value(log_offset) over w as fo, first_value(fingerprint) over w as ff from usable window w as (partition by tenant_id, idempotency_key order by log_offset rows between unbounded preceding and unbounded following)),
      judged as (select *, case when log_offset = fo then 'inserted' when ff is null or fingerprint is not distinct from ff then 'duplicate' else 'key_reuse' end as outcome from o),
      refused as (select log_offset, case when coalesce(idempotency_key, '') = '' then 'no_key' else 'bad_quantity' end as outcome from u where coalesce(idempotency_key, '') = '' or q is null)"""


_END = "(select coalesce(max(log_offset), -1) + 1 from usage_events)"
_EVENT = "log_offset, tenant_id, meter, quantity, epoch_us(occurred_at) as occurred_at, epoch_us(received_at) as received_at, idempotency_key, lower(hex(fingerprint)) as fingerprint"

ORACLE = {
    "drain_outcomes": f"with {_drained()} select log_offset, outcome from judged where outcome <> 'duplicate' union all select * from refused",
    "drain_replay": f"with {_drained()} select count(*) as read, 0 as inserted, count(*) filter (outcome <> 'key_reuse') as duplicates, count(*) filter (outcome = 'key_reuse') as conflicts, {_END} as next_offset from judged",
    "drain_resume": f"with {_drained()} select log_offset as id, tenant_id, idempotency_key, meter, cast(q as varchar) as quantity from judged where outcome = 'inserted'",
    "drain_positions": f"""with {_drained()}, half as (select {_END} // 2 as h) select 'all' as consumer, {_END} as next_offset, count(*) as stored from judged where outcome = 'inserted'
      union all select 'half', (select h from half), count(*) from judged, half where outcome = 'inserted' and log_offset < h""",
    "log_roundtrip": f"select {_EVENT} from usage_events",
    "log_range_read": f"select log_offset, tenant_id, idempotency_key from usage_events where log_offset >= {_END} * 9 // 10",
    "log_point_read": "select consumer, next_offset, tenant_id, idempotency_key, quantity from consumer_offsets join usage_events on log_offset = next_offset",
    "log_torn_tail": f"select log_offset, {_END} - 1 as torn_end, tenant_id, idempotency_key from usage_events",
    "fault_every_message_twice": f"""with {_drained()}, r as (select count(*) as n from refused) select 2 * (count(*) + max(n)) as read, count(*) filter (outcome = 'inserted') as inserted,
      2 * count(*) - count(*) filter (outcome = 'inserted') - 2 * count(*) filter (outcome = 'key_reuse') as duplicates, 2 * (count(*) filter (outcome = 'key_reuse') + max(n)) as conflicts from judged, r""",
    "fault_clock_skew": f"""select skew_hours, coalesce({_REASON}, 'usable') as verdict, count(*) as deliveries from (select * replace (occurred_at + to_hours(skew_hours) as occurred_at), skew_hours from usage_events, (values {", ".join(f"({h})" for h in SKEWS)}) as t(skew_hours)) group by 1, 2""",
    "body_faults": "select kind, case kind when 'large' then 413 else 400 end as status, 'malformed_request' as code, count(*) as requests from ingest_requests, (values ('cut'), ('large'), ('array'), ('misspelled'), ('number'), ('empty')) as t(kind) group by kind",
    "segmented_drain": f"""with {_drained()}, r as (select count(*) as n from refused) select count(*) + max(n) as read, count(*) filter (outcome = 'inserted') as inserted, count(*) filter (outcome = 'duplicate') as duplicates,
      count(*) filter (outcome = 'key_reuse') + max(n) as conflicts from judged, r""",
}
