"""Request bodies as JSON text, decoded strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.validation import BODY_BYTES, rejection

FIELDS = ("tenant_id", "meter", "quantity", "occurred_at", "idempotency_key")


def encode_event() -> Column:
    """A log record: JSON of an event row, fields in declared order, so equal events give equal bytes."""
    from tallymill.functions.fingerprint import rfc3339_nano

    return F.to_json(F.struct("tenant_id", "meter", "quantity", rfc3339_nano(F.col("occurred_at")).alias("occurred_at"), rfc3339_nano(F.col("received_at")).alias("received_at"), "idempotency_key", F.base64("fingerprint").alias("fingerprint")))


_EVENT = "tenant_id string, meter string, quantity string, occurred_at string, received_at string, idempotency_key string, fingerprint string"


def read_bodies(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(body): one request body per line of the text files at ``path``, as a table or as a stream."""
    return (spark.readStream if streaming else spark.read).schema("value string").text(path).withColumnRenamed("value", "body")


def _members(body: Column) -> Column:
    """The object's members as map of variants; null unless the text is one JSON object."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed.cast("map<string,variant>"))


def _only_strings(members: Column, fields: tuple[str, ...]) -> Column:
    kind = lambda v: F.schema_of_variant(v).isin("STRING", "VOID")
    return F.forall(F.map_entries(members), lambda e: e["key"].isin(*fields) & (e["value"].isNull() | kind(e["value"])))


def decode_event(payload: Column) -> Column:
    """The event struct of a log record, null if it can't be decoded or has an unknown field."""
    fields = tuple(x.split()[0] for x in _EVENT.split(", "))
    event = F.from_json(payload, _EVENT)
    strict = F.coalesce(_only_strings(_members(payload), fields), F.lit(False))
    instant = lambda name: F.try_to_timestamp(event[name]).alias(name)
    return F.when(strict, F.struct(event["tenant_id"].alias("tenant_id"), event["meter"].alias("meter"), event["quantity"].alias("quantity"), instant("occurred_at"), instant("received_at"), event["idempotency_key"].alias("idempotency_key"), F.unbase64(event["fingerprint"]).alias("fingerprint")))


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """(request_id, received_at, the five fields, rejected): ``rejected`` is null for an acceptable request.

    Bodies over 64 KiB get 413; unknown fields, values that aren't strings, and text that isn't one JSON object get 400.
    Names are compared exactly and repeated names are refused, which is stricter than a decoder that lets the last win.
    """
    read = bodies.withColumn("__m", _members(F.col("body"))).withColumn("__ok", F.coalesce(_only_strings(F.col("__m"), FIELDS), F.lit(False)))
    fields = [F.when(F.col("__ok"), F.try_variant_get(F.try_element_at("__m", F.lit(f)), "$", "string")).alias(f) for f in FIELDS]
    rows = read.select("request_id", "received_at", *fields, F.octet_length("body").alias("__bytes"), "__ok")
    fail = lambda status, detail: F.struct(F.lit(status).alias("status"), F.lit("malformed_request").alias("code"), F.lit(detail).alias("detail"))
    rejected = F.when(F.col("__bytes") > BODY_BYTES, fail(413, "body is too large")).when(~F.col("__ok"), fail(400, "body is not a valid request")).otherwise(rejection(F.col("received_at")))
    return rows.withColumn("rejected", rejected).drop("__bytes", "__ok")
