"""The rules a request must meet, as one CASE in their order: the first that fails decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.fingerprint import is_rfc3339, rfc3339_instant

# Limits of the request contract.
LONGEST_FIELD = 255
INTEGER_DIGITS = 29
FRACTION_DIGITS = 9
SKEW_SECONDS = 5 * 60
BACKFILL_DAYS = 35
BODY_BYTES = 64 * 1024


# Fixed values, here and below: the statuses, codes and details that clients are answered with.
def _outcome(status: int, code: str, detail: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), F.lit(detail).alias("detail"))


def _invalid(name: str, reason: str) -> Column:
    return _outcome(400, "invalid_field", f"{name} {reason}")


def _string_rules(name: str) -> list[tuple[Column, Column]]:
    value = F.coalesce(F.col(name), F.lit(""))
    return [
        (value == "", _invalid(name, "is required")),
        (F.octet_length(value) > LONGEST_FIELD, _invalid(name, f"must be at most {LONGEST_FIELD} bytes")),
        (value.rlike(r"\A\p{IsWhite_Space}|\p{IsWhite_Space}\z"), _invalid(name, "must not have leading or trailing whitespace")),
    ]


def _quantity_rules() -> list[tuple[Column, Column]]:
    q = F.coalesce(F.col("quantity"), F.lit(""))
    whole, fraction, point = F.regexp_extract(q, r"\A([^.]*)", 1), F.regexp_extract(q, r"(?s)\A[^.]*\.(.*)\z", 1), F.contains(q, F.lit("."))
    fail = lambda reason: _invalid("quantity", reason)
    return [
        (q == "", fail("is required")),
        (q.rlike("[eE]"), fail("must not use scientific notation")),
        (q.startswith("-"), fail("must not be negative")),
        (q.startswith("+"), fail("must not have a leading plus sign")),
        (whole == "", fail("must have at least one digit before the decimal point")),
        (point & (fraction == ""), fail("must have at least one digit after the decimal point")),
        (~q.rlike(r"\A[0-9]+(\.[0-9]+)?\z"), fail("must be a decimal number")),
        (F.length(F.regexp_replace(whole, "^0+", "")) > INTEGER_DIGITS, fail(f"must have at most {INTEGER_DIGITS} digits before the decimal point")),
        (F.length(fraction) > FRACTION_DIGITS, fail(f"must have at most {FRACTION_DIGITS} digits after the decimal point")),
    ]


def _time_rules(now: Column) -> list[tuple[Column, Column]]:
    at = F.unix_micros(rfc3339_instant(F.col("occurred_at")))
    clock = F.unix_micros(now)
    zero = F.unix_micros(F.lit("0001-01-01T00:00:00Z").cast("timestamp"))
    return [
        (at.isNull() | (at == zero), _invalid("occurred_at", "is required")),
        (at > clock + SKEW_SECONDS * 1_000_000, _invalid("occurred_at", "must not be in the future")),
        (at < clock - BACKFILL_DAYS * 86_400_000_000, _outcome(422, "event_too_old", f"occurred_at is more than {BACKFILL_DAYS} days old; use the backfill path")),
    ]


def rejection(now: Column) -> Column:
    """struct(status, code, detail) of the first rule a request row breaks, null if it breaks none.

    ``occurred_at`` is text; text that isn't RFC 3339 can't be decoded and comes before all field rules. ``now`` is the
    row's own arrival: no rule reads a clock.
    """
    malformed = (F.col("occurred_at").isNotNull() & ~F.coalesce(is_rfc3339(F.col("occurred_at")), F.lit(False)), _outcome(400, "malformed_request", "occurred_at is not an RFC 3339 time"))
    rules = [malformed, *(r for name in ("tenant_id", "meter", "idempotency_key") for r in _string_rules(name)), *_quantity_rules(), *_time_rules(now)]
    case = F.when(*rules[0])
    for condition, outcome in rules[1:]:
        case = case.when(condition, outcome)
    return case
