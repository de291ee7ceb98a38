"""Literals of conditions, narrowed to a column's type before Spark sees them."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemere.errors import InvalidQuery

_BITS = {"INTEGER": 32, "LONG": 64}


def is_number(value: object) -> bool:
    """Booleans are no numbers here."""
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def to_integer(value: int | float, bits: int) -> int:
    """Two's complement of so many bits: fractions are cut, integers wrap, floats stop at the ends, NaN is 0."""
    top = 1 << (bits - 1)
    if isinstance(value, float):
        if math.isnan(value):
            return 0
        return max(-top, min(top - 1, int(value) if math.isfinite(value) else (top if value > 0 else -top)))
    return (value + top) % (2 * top) - top


def text_of(value: object) -> str:
    """A literal as text, booleans in lower case."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def narrowed(value: object, logical: str) -> Column:
    """The literal for comparing with a column of this type; InvalidQuery if it is of the wrong kind."""
    if logical in _BITS and is_number(value):
        bits = _BITS[logical]
        return F.lit(to_integer(value, bits)).cast("int" if bits == 32 else "long")
    if logical in ("FLOAT", "DOUBLE") and is_number(value):
        return F.lit(float(value)).cast(logical.lower())
    if logical == "BOOLEAN" and isinstance(value, bool):
        return F.lit(value)
    if logical == "STRING" and isinstance(value, str):
        return F.lit(value)
    raise InvalidQuery(f"{value!r} is no literal for a column of type {logical}")


def instant(millis: int, zoned: bool) -> Column | None:
    """Milliseconds since 1970 as a timestamp literal; None beyond the years that literals have."""
    try:
        at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=millis)
    except OverflowError:
        return None
    if zoned:
        return F.timestamp_millis(F.lit(millis).cast("long"))
    return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ')}'")
