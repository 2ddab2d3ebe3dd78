"""Quantities are strings until they become DECIMAL(38,9); no float touches them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII digits, optionally a point and 1 to 9 more; at most 29 before the point, leading zeros aside.
PLAIN = r"\A0*[0-9]{1,29}(\.[0-9]{1,9})?\z"


def is_plain(quantity: str = "quantity") -> Column:
    """Whether the text is a plain quantity; false for null."""
    return F.coalesce(F.col(quantity).rlike(PLAIN), F.lit(False))


def as_decimal(quantity: str = "quantity") -> Column:
    """The plain quantity as DECIMAL(38,9), else null."""
    return F.when(is_plain(quantity), F.col(quantity).try_cast("decimal(38,9)"))


def canonical(quantity: Column) -> Column:
    """Leading zeros of the integer part, trailing zeros of the fraction and a bare point removed."""
    text = F.regexp_replace(quantity, r"^0+(?=[0-9])", "")
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(text, r"\.$", "")
