"""Identity of a message: (tenant_id, idempotency_key), and order among its deliveries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An offset or id below this bound fits beside the clock in one DECIMAL(38,0).
_OFFSETS = 10**19


def has_key(key: str = "idempotency_key") -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(F.col(key) != "", F.lit(False))


def id_hi(*columns: str) -> Column:
    """First 64 bits of the 128-bit identifier. Nulls count as a value of their own."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def id_lo(*columns: str) -> Column:
    """Second 64 bits, from another chain of the same hash."""
    return F.xxhash64(F.lit("second half"), *[x for c in reversed(columns) for x in (F.col(c), F.col(c).isNull())])


def delivery_order(received: str = "received_at", offset: str = "log_offset") -> Column:
    """One fixed-width number that sorts by (received, offset), nulls of ``received`` last.

    A struct would do, but its minimum can't be held in a hash aggregate's fixed-width buffer.
    """
    micros = F.coalesce(F.unix_micros(F.col(received)), F.lit(9_000_000_000_000_000_000))
    return micros.cast("decimal(38,0)") * F.lit(str(_OFFSETS)).cast("decimal(20,0)") + F.col(offset).cast("decimal(38,0)")


def offset_in(order: str) -> Column:
    """The offset within a ``delivery_order``."""
    return F.pmod(F.col(order), F.lit(str(_OFFSETS)).cast("decimal(20,0)")).cast("bigint")
