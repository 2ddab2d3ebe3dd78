"""The Parquet tables, with the columns each reader may rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymill.session import importable

_s, _l, _t, _b = T.StringType(), T.LongType(), T.TimestampType(), T.BinaryType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


USAGE_EVENTS = _schema(log_offset=_l, batch_id=_l, tenant_id=_s, meter=_s, quantity=_s, occurred_at=_t, received_at=_t, idempotency_key=_s, fingerprint=_b)
STORED_EVENTS = _schema(id=_l, tenant_id=_s, meter=_s, quantity=T.DecimalType(38, 9), occurred_at=_t, received_at=_t, idempotency_key=_s, payload_fingerprint=_b)
INGEST_REQUESTS = _schema(request_id=_l, tenant_id=_s, meter=_s, quantity=_s, occurred_at=_s, idempotency_key=_s, received_at=_t)
CONSUMER_OFFSETS = _schema(consumer=_s, next_offset=_l, updated_at=_t)

SCHEMAS = {"usage_events": USAGE_EVENTS, "stored_events": STORED_EVENTS, "ingest_requests": INGEST_REQUESTS, "consumer_offsets": CONSUMER_OFFSETS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``name`` below ``sf_dir``. Known tables get their declared schema: nothing is inferred."""
    reader = importable(spark).read.schema(SCHEMAS[name]) if name in SCHEMAS else importable(spark).read
    return reader.parquet(f"{sf_dir}/{name}.parquet")
