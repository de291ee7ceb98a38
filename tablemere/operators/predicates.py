"""Conditions as column predicates."""

from __future__ import annotations

import datetime as dt
import operator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemere.errors import InvalidQuery
from tablemere.functions.literals import instant, is_number, narrowed, text_of, to_integer
from tablemere.functions.names import quoted
from tablemere.functions.semantics import Semantics
from tablemere.functions.types import logical_type

COMPARE = {
    "EQUALS": operator.eq,
    "NOT_EQUALS": operator.ne,
    "LESS_THAN": operator.lt,
    "LESS_THAN_OR_EQUALS": operator.le,
    "GREATER_THAN": operator.gt,
    "GREATER_THAN_OR_EQUALS": operator.ge,
}
OPERATORS = (*COMPARE, "LIKE", "IS_NULL", "IS_NOT_NULL")
SYMBOLS = {
    "=": "EQUALS", "!=": "NOT_EQUALS", "<>": "NOT_EQUALS", "<": "LESS_THAN", "<=": "LESS_THAN_OR_EQUALS",
    ">": "GREATER_THAN", ">=": "GREATER_THAN_OR_EQUALS", "LIKE": "LIKE", "IS NULL": "IS_NULL", "IS NOT NULL": "IS_NOT_NULL",
}


def like_regex(pattern: str, underscore: bool = True) -> str:
    """The whole-text regular expression that a LIKE pattern is under ``regex_like``."""
    body = pattern.replace("%", ".*")
    return rf"\A(?:{body.replace('_', '.') if underscore else body})\z"


def _compiles(spark: SparkSession, regex: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _like(col: Column, pattern: str, semantics: Semantics) -> Column:
    if not semantics.regex_like:
        return col.like(pattern)
    regex = like_regex(pattern, semantics.underscore_like)
    return col.rlike(regex) if _compiles(SparkSession.active(), regex) else F.lit(False)


def _temporal(col: Column, kind: T.DataType, op: str, value: object) -> Column:
    """Compare a date or timestamp with a native literal or with milliseconds since 1970.

    Milliseconds stay on the literal's side where they can, as a range of one
    millisecond, so that the predicate reaches the scan.
    """
    compare = COMPARE[op]
    if isinstance(value, (dt.datetime, dt.date, str)):
        text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
        return compare(col, F.lit(text).cast(kind))
    if not is_number(value):
        raise InvalidQuery(f"{value!r} is no literal for a date or timestamp")
    millis = to_integer(value, 64)
    if isinstance(kind, T.DateType):
        return compare(F.unix_date(col).cast("long") * 86_400_000, F.lit(millis).cast("long"))
    zoned = isinstance(kind, T.TimestampType)
    this, after = instant(millis, zoned), instant(millis + 1, zoned)
    if this is None or after is None:
        epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        own = F.unix_millis(col) if zoned else F.timestamp_diff("MILLISECOND", epoch, col)
        return compare(own, F.lit(millis).cast("long"))
    return {
        "EQUALS": (col >= this) & (col < after),
        "NOT_EQUALS": (col < this) | (col >= after),
        "LESS_THAN": col < this,
        "LESS_THAN_OR_EQUALS": col < after,
        "GREATER_THAN": col >= after,
        "GREATER_THAN_OR_EQUALS": col >= this,
    }[op]


def _floating(col: Column, lit: Column, value: float, op: str, semantics: Semantics) -> Column:
    plain = COMPARE[op](col, lit)
    if not semantics.ieee_nan:
        return plain
    if value != value:  # nothing equals or exceeds NaN, everything differs from it
        return col.isNotNull() if op == "NOT_EQUALS" else F.lit(False)
    return plain & ~F.isnan(col) if op in ("GREATER_THAN", "GREATER_THAN_OR_EQUALS") else plain


def _checked(name: str, kind: T.DataType, op: str, value: object, semantics: Semantics) -> Column:
    col, logical = F.col(quoted(name)), logical_type(kind)
    if op == "IS_NULL":
        return col.isNull()
    if op == "IS_NOT_NULL":
        return col.isNotNull()
    if value is None:
        return F.lit(False)
    if op == "LIKE":
        if logical != "STRING" or not (isinstance(value, str) or semantics.lenient_predicates):
            raise InvalidQuery(f"LIKE needs a text column and a pattern, not {logical} and {value!r}")
        return _like(col, text_of(value), semantics)
    if logical in ("STRING", "BOOLEAN") and op not in ("EQUALS", "NOT_EQUALS"):
        raise InvalidQuery(f"{op} doesn't compare columns of type {logical}")
    if logical in ("DATE", "TIMESTAMP"):
        return _temporal(col, kind, op, value)
    if logical == "STRING" and semantics.lenient_predicates:
        value = text_of(value)
    lit = narrowed(value, logical)
    if logical in ("FLOAT", "DOUBLE"):
        return _floating(col, lit, float(value), op, semantics)
    return COMPARE[op](col, lit)


def predicate(name: str, kind: T.DataType, op: str, value: object, semantics: Semantics) -> Column:
    """The predicate of one condition on a column of this Spark type.

    A null cell satisfies nothing but IS_NULL, and a null literal is satisfied
    by nothing. An operator or a literal that doesn't fit the type is refused
    before anything runs or, under ``lenient_predicates``, satisfied by nothing.
    """
    if op not in OPERATORS:
        raise InvalidQuery(f"unknown operator {op!r}")
    try:
        return _checked(name, kind, op, value, semantics)
    except InvalidQuery:
        if semantics.lenient_predicates:
            return F.lit(False)
        raise


def text_equals(name: str, value: str) -> Column:
    """Whether the cell, written as text, is this text; null cells are not."""
    return F.col(quoted(name)).cast("string") == F.lit(value)
