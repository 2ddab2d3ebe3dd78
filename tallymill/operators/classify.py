"""Each delivery is inserted, a duplicate, or a conflict: the same key with other content.

Order in the log decides which delivery is first, as in a consumer that takes one record after another. A key that is
already stored makes every delivery a duplicate or conflict. Fingerprints are compared with the *first* (or stored) row:
no stored fingerprint means duplicate, a missing one against a stored one means conflict.

Firsts are found by an aggregation that thins hot keys before its shuffle; they are joined back with the heavy keys'
firsts broadcast (``skew_join``), so a key that makes up a third of the log is spread over all tasks. Rows without key
aren't classified. Null tenants are a tenant of their own. Extra columns of the log are kept, but for those named like the
two results; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keys import has_key, id_hi, id_lo
from tallymill.operators.skew import skew_join

_MESSAGE = "__message"
#: Above every rank of a stored row.
_STORED = 1 << 62


def _identity(hi: Column, lo: Column) -> Column:
    return F.concat(F.hex(hi), F.lit("."), F.hex(lo))


def _with_message(df: DataFrame) -> DataFrame:
    if "idempotency_key" not in df.columns:  # stored rows that come by their identifier
        return df.withColumn(_MESSAGE, _identity(F.col("hi"), F.col("lo")))
    return df.where(has_key()).withColumn(_MESSAGE, _identity(id_hi("tenant_id", "idempotency_key"), id_lo("tenant_id", "idempotency_key")))


def first_rows(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(message, __first_offset, __first_fingerprint): the row that each key's deliveries are compared with.

    ``stored`` rows come before all of the log and have negative offsets here; they have tenant_id and idempotency_key, or hi and lo. If they have a column ``rank`` (not negative), the lowest is first
    among rows of one key.
    """
    of_log = _with_message(log).select(_MESSAGE, F.col("log_offset").alias("o"), F.hex("fingerprint").alias("f"))
    if stored is not None:
        of_log = of_log.unionByName(_with_message(stored).select(_MESSAGE, ((F.col("rank") if "rank" in stored.columns else F.lit(0)) - _STORED).cast("bigint").alias("o"), F.hex("payload_fingerprint").alias("f")))
    return of_log.groupBy(_MESSAGE).agg(F.min("o").alias("__first_offset"), F.min_by("f", "o").alias("__first_fingerprint"))


def classify(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``log`` with ``outcome`` and ``first_fingerprint`` (hex)."""
    joined = skew_join(_with_message(log), first_rows(log, stored), _MESSAGE)
    same = F.col("__first_fingerprint").isNull() | F.hex("fingerprint").eqNullSafe(F.col("__first_fingerprint"))
    outcome = F.when(F.col("log_offset") == F.col("__first_offset"), "inserted").when(same, "duplicate").otherwise("conflict")
    return joined.withColumns({"outcome": outcome, "first_fingerprint": F.col("__first_fingerprint")}).drop(_MESSAGE, "__first_offset", "__first_fingerprint")
