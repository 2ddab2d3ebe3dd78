import hashlib
import struct
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tallymill.functions.fingerprint import fingerprint, rfc3339_nano, rfc3339_text_in_utc
from tallymill.functions.quantity import canonical
from tallymill.functions.validation import rejection
from tallymill.sources.requests import decode_event, encode_event, parse_bodies
from tests.helpers import NOON, usage

BASE = {"tenant_id": "acme", "meter": "api_calls", "quantity": "1", "occurred_at": "2026-08-03T11:00:00Z", "idempotency_key": "key-1"}


def at(delta):
    return (NOON + delta).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


CASES = [
    ({}, None),
    *[({f: v}, ("invalid_field", f"{f} is required")) for f in ("tenant_id", "meter", "idempotency_key", "quantity") for v in ("", None)],
    *[({"tenant_id": v}, ("invalid_field", "tenant_id must not have leading or trailing whitespace")) for v in ("acme ", " acme", "acme\t", " acme", "acme\n", " ")],
    ({"tenant_id": "a" * 256}, ("invalid_field", "tenant_id must be at most 255 bytes")),
    ({"tenant_id": "é" * 128}, ("invalid_field", "tenant_id must be at most 255 bytes")),
    ({"tenant_id": "é" * 127 + "a"}, None),
    ({"quantity": "-1"}, ("invalid_field", "quantity must not be negative")),
    ({"quantity": "+1"}, ("invalid_field", "quantity must not have a leading plus sign")),
    ({"quantity": "1e5"}, ("invalid_field", "quantity must not use scientific notation")),
    ({"quantity": "one"}, ("invalid_field", "quantity must not use scientific notation")),
    ({"quantity": "many"}, ("invalid_field", "quantity must be a decimal number")),
    ({"quantity": "1.2.3"}, ("invalid_field", "quantity must be a decimal number")),
    ({"quantity": "٣"}, ("invalid_field", "quantity must be a decimal number")),
    ({"quantity": "1\n"}, ("invalid_field", "quantity must be a decimal number")),
    ({"quantity": ".5"}, ("invalid_field", "quantity must have at least one digit before the decimal point")),
    ({"quantity": "1."}, ("invalid_field", "quantity must have at least one digit after the decimal point")),
    ({"quantity": "000001.5"}, None),
    ({"quantity": "9" * 29 + "." + "9" * 9}, None),
    ({"quantity": "0" * 50 + "1"}, None),
    ({"quantity": "9" * 30}, ("invalid_field", "quantity must have at most 29 digits before the decimal point")),
    ({"quantity": "1." + "0" * 10}, ("invalid_field", "quantity must have at most 9 digits after the decimal point")),
    ({"occurred_at": None}, ("invalid_field", "occurred_at is required")),
    ({"occurred_at": "0001-01-01T00:00:00Z"}, ("invalid_field", "occurred_at is required")),
    *[({"occurred_at": v}, ("malformed_request", "occurred_at is not an RFC 3339 time")) for v in ("", "2026-08-03", "yesterday", "2026-08-03T11:00:00", "2026-13-03T11:00:00Z", "2026-08-03 11:00:00Z")],
    ({"occurred_at": at(timedelta(minutes=5))}, None),
    ({"occurred_at": at(timedelta(minutes=5, microseconds=1))}, ("invalid_field", "occurred_at must not be in the future")),
    ({"occurred_at": at(-timedelta(days=35))}, None),
    ({"occurred_at": at(-timedelta(days=35, microseconds=1))}, ("event_too_old", "occurred_at is more than 35 days old; use the backfill path")),
    ({"occurred_at": "2026-08-03T13:00:00+02:00"}, None),
    # the first rule that fails decides
    ({"tenant_id": "", "quantity": "-1"}, ("invalid_field", "tenant_id is required")),
    ({"tenant_id": "", "occurred_at": "x"}, ("malformed_request", "occurred_at is not an RFC 3339 time")),
]


def test_every_rule(spark):
    names = list(BASE)
    rows = [(k, *{**BASE, **change}.values(), NOON) for k, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} string" for n in names) + ", received_at timestamp")
    got = {r["id"]: r["r"] for r in df.select("id", rejection(F.col("received_at")).alias("r")).collect()}
    for k, (change, want) in enumerate(CASES):
        assert (got[k] and (got[k]["code"], got[k]["detail"])) == want, change
        assert got[k] is None or got[k]["status"] == (422 if want[0] == "event_too_old" else 400)


BODIES = [
    ('{"tenant_id":"acme","meter":"m","quantity":"1","occurred_at":"2026-08-03T11:00:00Z","idempotency_key":"k"}', None),
    ("", 400), ("{oops", 400), ("[]", 400), ('"text"', 400), ("null", 400), (None, 400),
    ('{"tenant_id":"acme","quanity":"1"}', 400),
    ('{"tenant_id":"acme","meter":"m","quantity":1,"occurred_at":"2026-08-03T11:00:00Z","idempotency_key":"k"}', 400),
    ('{"tenant_id":"acme","meter":"m","quantity":"1","occurred_at":"2026-08-03T11:00:00Z","idempotency_key":"k","received_at":"2026-08-03T11:00:00Z"}', 400),
    ('{"tenant_id":{"a":"b"}}', 400), ("{}", 400), ('{"tenant_id":null}', 400),
    ('{"tenant_id":"' + "a" * 70000 + '"}', 413),
]


def test_bodies_are_decoded_strictly(spark):
    df = spark.createDataFrame([(k, NOON, b) for k, (b, _) in enumerate(BODIES)], "request_id bigint, received_at timestamp, body string")
    got = {r["request_id"]: r["rejected"] and r["rejected"]["status"] for r in parse_bodies(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(BODIES)}


@pytest.mark.parametrize(("text", "want"), [("1", "1"), ("1.0", "1"), ("1.500", "1.5"), ("0001", "1"), ("0001.000", "1"), ("0", "0"), ("0.0", "0"), ("0.000000001", "0.000000001"), ("10", "10"), ("100.100", "100.1")])
def test_canonical(spark, text, want):
    assert spark.range(1).select(canonical(F.lit(text))).first()[0] == want


def _sha(*fields):
    return hashlib.sha256(b"".join(struct.pack(">Q", len(f.encode())) + f.encode() for f in fields)).digest()


def test_fingerprint(spark):
    rows = [("acmé", "api_calls", "01.50"), ("ab", "c", "1"), ("a", "bc", "1"), (None, "m", "1")]
    df = spark.createDataFrame(rows, "t string, m string, q string").withColumn("at", F.lit("2026-08-03T11:00:00.120000Z").cast("timestamp"))
    got = [r[0] for r in df.select(fingerprint(F.col("t"), F.col("m"), F.col("q"), rfc3339_nano(F.col("at")))).collect()]
    when = "2026-08-03T11:00:00.12Z"
    assert [g and bytes(g) for g in got] == [_sha("acmé", "api_calls", "1.5", when), _sha("ab", "c", "1", when), _sha("a", "bc", "1", when), None]


@pytest.mark.parametrize(("text", "want"), [("2026-08-03T13:00:00.120000000+02:00", "2026-08-03T11:00:00.12Z"), ("2026-08-03T11:00:00.000000001Z", "2026-08-03T11:00:00.000000001Z"), ("2026-08-03T20:00:00-11:30", "2026-08-04T07:30:00Z"), ("2026-08-03T11:00:00.000Z", "2026-08-03T11:00:00Z"), ("junk", None), (None, None)])
def test_time_text_keeps_nanoseconds(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rfc3339_text_in_utc(F.col("t"))).first()[0] == want


def test_event_codec(spark):
    df = usage(spark, [{}, {"tenant_id": None, "fingerprint": None, "occurred_at": None}, {"tenant_id": 'a"\\\n é', "quantity": "1.50"}])
    back = df.withColumn("payload", encode_event()).withColumn("b", decode_event(F.col("payload")))
    for r in back.collect():
        assert all(r[c] == r["b"][c] for c in ("tenant_id", "meter", "quantity", "occurred_at", "received_at", "idempotency_key", "fingerprint"))
    assert back.orderBy("log_offset").first()["payload"].startswith('{"tenant_id":"acme","meter":"api_calls","quantity":"1","occurred_at":"2026-08-03T11:00:00Z"')
    bad = spark.createDataFrame([("{oops",), ('{"tenant_id":"a","surprise":"b"}',), ('{"quantity":1}',), (None,)], "p string")
    assert [r[0] for r in bad.select(decode_event(F.col("p"))).collect()] == [None] * 4
