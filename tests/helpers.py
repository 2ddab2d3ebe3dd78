from datetime import datetime, timedelta, timezone

from tallymill.sources.tables import USAGE_EVENTS

NOON = datetime(2026, 8, 3, 12, tzinfo=timezone.utc)


def usage(spark, rows, **extra):
    """A delivery log of dicts; what a dict leaves out is filled in."""
    full = []
    for k, r in enumerate(rows):
        base = {"log_offset": k, "batch_id": 0, "tenant_id": "acme", "meter": "api_calls", "quantity": "1", "occurred_at": NOON - timedelta(hours=1), "received_at": NOON, "idempotency_key": f"key-{k}", "fingerprint": b"f"}
        full.append(tuple({**base, **r}.values()))
    return spark.createDataFrame(full, USAGE_EVENTS)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(df):
    """The numbers of a one-column result in order."""
    return sorted(r[0] for r in df.collect())
