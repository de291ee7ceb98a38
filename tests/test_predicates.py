import datetime as dt
import math

import pytest
from pyspark.sql import types as T

from tablemere import ANSI, REFERENCE, Engine, QuerySpec
from tablemere.errors import InvalidQuery, UnknownColumn
from tablemere.functions.literals import to_integer

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()),
        T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()),
        T.StructField("s", T.StringType()), T.StructField("day", T.DateType()), T.StructField("at", T.TimestampType()),
        T.StructField("local", T.TimestampNTZType()),
    ]
)
NOON = dt.datetime(2024, 1, 1, 12, 0, 0, 1500)
UTC = NOON.replace(tzinfo=dt.timezone.utc)
ROWS = [
    (1, 10, 10, 0.1, 0.1, True, "a.c", dt.date(2024, 1, 1), UTC, NOON),
    (2, -5, 2**40, 2.5, math.nan, False, "abc", dt.date(1969, 12, 31), UTC + dt.timedelta(days=1), NOON + dt.timedelta(days=1)),
    (3, 2**31 - 1, -(2**63), math.nan, math.inf, True, "a\nc", dt.date(2024, 1, 2), UTC - dt.timedelta(days=1), NOON - dt.timedelta(days=1)),
    (4, None, None, None, None, None, None, None, None, None),
]
MILLIS = 1704110400001  # of NOON, cut


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(rows, column, op, value=None, semantics=ANSI):
    engine = Engine(rows.sparkSession, semantics)
    engine.catalog.register("t", rows)
    return sorted(r["id"] for r in engine.query(QuerySpec("t", ("id",)).where(column, op, value)).collect())


@pytest.mark.parametrize(
    "column,op,value,want",
    [
        ("i", "=", 10, [1]), ("i", "!=", 10, [2, 3]), ("i", "<", 10, [2]), ("i", "<=", 10, [1, 2]), ("i", ">", 10, [3]), ("i", ">=", 10, [1, 3]),
        ("i", "=", 10.9, [1]), ("i", "=", 2**31 + 2**31 - 5 - 2**32 + 2**32, [2] if to_integer(2**32 - 5, 32) == -5 else []),
        ("i", "=", 1e12, [3]), ("l", ">", 10, [2]), ("l", "=", -1e30, [3]), ("f", "=", 0.1, [1]), ("d", "<=", 0.1, [1]),
        ("b", "=", True, [1, 3]), ("b", "!=", True, [2]), ("s", "=", "abc", [2]), ("s", "!=", "abc", [1, 3]),
        ("s", "LIKE", "a%", [1, 2, 3]), ("s", "LIKE", "a_c", [1, 2, 3]), ("s", "LIKE", "a.c", [1]), ("s", "LIKE", "(", []),
        ("i", "IS NULL", None, [4]), ("i", "IS NOT NULL", None, [1, 2, 3]), ("i", "=", None, []), ("i", "!=", None, []),
        ("at", "=", MILLIS, [1]), ("at", ">", MILLIS, [2]), ("at", "<", MILLIS, [3]), ("at", ">=", MILLIS, [1, 2]), ("at", "<=", MILLIS, [1, 3]),
        ("at", "!=", MILLIS, [2, 3]), ("local", "=", MILLIS, [1]), ("local", ">", MILLIS, [2]), ("local", "<=", MILLIS, [1, 3]),
        ("local", "<", 10**18, [1, 2, 3]), ("at", ">", -(10**18), [1, 2, 3]), ("day", "=", 1704067200000, [1]), ("day", "<", 0, [2]),
        ("day", ">=", dt.date(2024, 1, 2), [3]), ("local", ">=", "2024-01-02 00:00:00", [2]),
    ],
)
def test_ansi(rows, column, op, value, want):
    assert ids(rows, column, op, value) == want


@pytest.mark.parametrize(
    "column,op,value,want",
    [
        ("s", "LIKE", "a.c", [1, 2]), ("s", "LIKE", "a%", [1, 2]), ("s", "LIKE", "a_c", [1, 2]), ("s", "LIKE", "(", []),
        ("d", ">", 0.0, [1, 3]), ("d", "<", 1.0, [1]), ("d", "=", math.nan, []), ("d", "!=", math.nan, [1, 2, 3]), ("f", ">=", 0.1, [1, 2]),
        ("i", "=", "25", []), ("i", "=", True, []), ("s", "<", "b", []), ("i", "LIKE", "1%", []), ("b", "<", True, []), ("s", "=", 5, []),
    ],
)
def test_reference(rows, column, op, value, want):
    assert ids(rows, column, op, value, REFERENCE) == want


@pytest.mark.parametrize("column,op,value", [("i", "=", "25"), ("i", "=", True), ("s", "<", "b"), ("i", "LIKE", "1%"), ("b", "<", True), ("b", "=", 1), ("at", "=", True)])
def test_strict_refuses(rows, column, op, value):
    with pytest.raises(InvalidQuery):
        ids(rows, column, op, value)


def test_unknown_names(rows):
    with pytest.raises(UnknownColumn):
        ids(rows, "I", "=", 1)
    with pytest.raises(InvalidQuery):
        ids(rows, "i", "ABOUT", 1)


@pytest.mark.parametrize(
    "value,bits,want",
    [(2**31, 32, -(2**31)), (-1, 32, -1), (10.9, 32, 10), (-10.9, 32, -10), (1e12, 32, 2**31 - 1), (-1e12, 32, -(2**31)), (math.nan, 32, 0), (2**63, 64, -(2**63)), (math.inf, 64, 2**63 - 1)],
)
def test_narrowing(value, bits, want):
    assert to_integer(value, bits) == want


def test_filters_reach_the_scan(spark):
    engine = Engine(spark)
    engine.catalog.create_from_parquet("part", "/root/testdata/sf0.001/part.parquet")
    plan = engine.query(QuerySpec("part", ("p_partkey",)).where("p_size", ">", 25))._jdf.queryExecution().toString()
    assert "GreaterThan(p_size,25)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
