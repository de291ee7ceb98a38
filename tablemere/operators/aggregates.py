"""Aggregate functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemere.errors import InvalidQuery, UnsupportedType
from tablemere.functions.names import quoted
from tablemere.functions.semantics import Semantics
from tablemere.functions.types import NUMERIC, logical_type

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def function_named(name: str) -> str:
    if str(name).upper() not in FUNCTIONS:
        raise InvalidQuery(f"unknown aggregate function {name!r}")
    return name.upper()


def wrapped_long(col: Column) -> Column:
    """A whole decimal as a LONG that wraps around."""
    half, whole = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(21,0)")
    return (F.pmod(col + half, whole) - half).cast("long")


def wrapped_sum(col: Column, logical: str) -> Column:
    """SUM in the type of its input: integers wrap around, floats are summed as doubles and rounded once."""
    if logical == "INTEGER":
        return F.shiftright(F.shiftleft(F.sum(col.cast("long")), 32), 32).cast("int")
    if logical == "LONG":
        return wrapped_long(F.sum(col.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.sum(col).cast("float" if logical == "FLOAT" else "double")


def _sum(col: Column, logical: str, semantics: Semantics) -> Column:
    total = wrapped_sum(col, logical) if semantics.keep_sum_type else F.sum(col)
    return F.coalesce(total, F.lit(0)) if semantics.zero_for_null else total


def _extreme(fn: str, col: Column, logical: str, semantics: Semantics) -> Column:
    found = F.min(col) if fn == "MIN" else F.max(col)
    if semantics.ieee_nan and logical in ("FLOAT", "DOUBLE"):
        found = F.when(F.bool_or(F.isnan(col)), F.lit(float("nan")).cast(logical.lower())).otherwise(found)
    if semantics.zero_for_null:
        found = F.coalesce(found, F.lit("") if logical == "STRING" else F.lit(0).cast(logical.lower().replace("integer", "int")))
    return found


def aggregate(fn: str, name: str, kind: T.DataType | None, semantics: Semantics) -> Column:
    """One aggregate of a column; ``name`` ``*`` (with COUNT only) counts rows.

    Under ANSI semantics SUM, AVG, MIN and MAX skip nulls and are null without a
    value, and COUNT of a column counts what isn't null. See Semantics for the
    other rules.
    """
    fn = function_named(fn)
    rows = F.count(F.lit(1))
    if name == "*":
        if fn != "COUNT":
            raise InvalidQuery(f"{fn}(*) has no meaning")
        out = rows
    else:
        col, logical = F.col(quoted(name)), logical_type(kind)
        takes = NUMERIC if fn in ("SUM", "AVG") else (*NUMERIC, "STRING") if semantics.zero_for_null else None
        if fn != "COUNT" and ((takes and logical not in takes) or logical == "BOOLEAN"):
            raise UnsupportedType(f"{fn} doesn't take columns of type {logical}")
        if fn == "COUNT":
            out = rows if semantics.count_nulls else F.count(col)
        elif fn == "SUM":
            out = _sum(col, logical, semantics)
        elif fn == "AVG":
            out = _sum(col, logical, semantics).cast("double") / rows if semantics.count_nulls else F.avg(col)
        else:
            out = _extreme(fn, col, logical, semantics)
    return F.when(rows > 0, out) if semantics.null_when_empty else out


def column_counts(names: list[str]) -> list[Column]:
    """For one pass over a table: its rows, then the nulls of each column."""
    return [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(quoted(n)).isNull()).alias(f"n{i}") for i, n in enumerate(names)]
