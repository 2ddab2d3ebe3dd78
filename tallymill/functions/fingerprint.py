"""The content fingerprint: SHA-256 over length-prefixed billable fields, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.quantity import canonical

#: RFC 3339 with a zone: date, T, time, optional fraction, Z or an offset.
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def prefixed(value: Column) -> Column:
    """The value's UTF-8 bytes after their number as 8 bytes, big end first."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0")), F.encode(value, "UTF-8"))


def rfc3339_nano(instant: Column) -> Column:
    """UTC text of a timestamp without trailing zeros in the fraction; the session's zone must be UTC."""
    return F.concat(F.regexp_replace(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def is_rfc3339(text: Column) -> Column:
    """Whether the text has the form and names an instant; null for null."""
    return text.rlike(RFC3339) & F.try_to_timestamp(text).isNotNull()


def rfc3339_instant(text: Column) -> Column:
    """The instant of an RFC 3339 text to the microsecond, null for any other text."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def rfc3339_text_in_utc(text: Column) -> Column:
    """The text's instant in UTC with all digits of its fraction but trailing zeros, as nanoseconds don't fit a timestamp."""
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), "0+$", "")
    return F.concat(F.date_format(rfc3339_instant(text), "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def fingerprint(tenant: Column, meter: Column, quantity: Column, occurred_text: Column) -> Column:
    """32 bytes over tenant, meter, canonical quantity and UTC time; null if one of them is null.

    The key and the arrival stay out: they differ between deliveries of the same content.
    """
    return F.unhex(F.sha2(F.concat(prefixed(tenant), prefixed(meter), prefixed(canonical(quantity)), prefixed(occurred_text)), 256))
