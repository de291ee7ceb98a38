import math

import pytest

from tablemere import ANSI, REFERENCE, Engine, QuerySpec
from tablemere.errors import InvalidQuery, UnknownColumn, UnsupportedType


def run(df, spec, semantics=ANSI):
    engine = Engine(df.sparkSession, semantics)
    engine.catalog.register("t", df)
    return [tuple(r) for r in engine.query(spec).collect()]


def all_of(column):
    spec = QuerySpec("t")
    for fn in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
        spec = spec.aggregate(fn, column)
    return spec


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", None), ("b", None), (None, 7)], "k string, v int")


def test_null_rules(groups):
    spec = all_of("v").group_by("k").order_by_asc("k")
    assert run(groups, spec) == [(None, 1, 7, 7.0, 7, 7), ("a", 2, 4, 2.0, 1, 3), ("b", 0, None, None, None, None)]
    assert run(groups, spec, REFERENCE) == [(None, 1, 7, 7.0, 7, 7), ("a", 3, 4, 4 / 3, 1, 3), ("b", 2, 0, 0.0, 0, 0)]


def test_no_rows(groups):
    empty = groups.limit(0)
    assert run(empty, all_of("v")) == [(0, None, None, None, None)]
    assert run(empty, all_of("v"), REFERENCE) == [(None,) * 5]
    assert run(empty, all_of("v").group_by("k")) == []


@pytest.mark.parametrize("kind,values,want", [("int", [2**31 - 1, 1], -(2**31)), ("int", [-(2**31), -1], 2**31 - 1), ("bigint", [2**63 - 1, 1], -(2**63)), ("bigint", [-(2**63), -1], 2**63 - 1), ("bigint", [5, -7], -2)])
def test_wrapping_sum(spark, kind, values, want):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    assert run(df, QuerySpec("t").aggregate("SUM", "v"), REFERENCE) == [(want,)]


def test_floats(spark):
    df = spark.createDataFrame([(1.5, 2.5), (math.nan, 1.0)], "f float, d double")
    spec = QuerySpec("t").aggregate("MIN", "f", "lo").aggregate("MAX", "d", "hi")
    assert run(df, spec) == [(1.5, 2.5)]
    (lo, hi), = run(df, spec, REFERENCE)
    assert math.isnan(lo) and hi == 2.5


def test_text_and_types(spark):
    df = spark.createDataFrame([("b", True), ("a", False), (None, None)], "s string, b boolean")
    assert run(df, QuerySpec("t").aggregate("MIN", "s").aggregate("MAX", "s")) == [("a", "b")]
    for fn, column in (("SUM", "s"), ("AVG", "b"), ("MIN", "b")):
        with pytest.raises(UnsupportedType):
            run(df, QuerySpec("t").aggregate(fn, column))
    with pytest.raises(InvalidQuery):
        run(df, QuerySpec("t").aggregate("SUM", "*"))


def test_shape_and_errors(groups):
    engine = Engine(groups.sparkSession)
    engine.catalog.register("t", groups)
    spec = QuerySpec("t").select("v").group_by("k").aggregate("SUM", "v").aggregate("COUNT", "v", "n")
    assert engine.query(spec).columns == ["k", "SUM(v)", "n"]
    with pytest.raises(InvalidQuery):
        engine.query(QuerySpec("t").select("v").group_by("k").aggregate("COUNT", "*"))
    with pytest.raises(InvalidQuery):
        engine.query(QuerySpec("t").aggregate("SUM", "v", "x").aggregate("MIN", "v", "x"))
    with pytest.raises(UnknownColumn):
        engine.query(QuerySpec("t").group_by("k").aggregate("COUNT", "*", "n").order_by_asc("v"))
    assert sorted(run(groups, QuerySpec("t").group_by("k")), key=str) == [("a",), ("b",), (None,)]


def test_limit_before_group(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, k int").coalesce(1)
    got = run(df, QuerySpec("t").group_by("k").aggregate("COUNT", "*", "n").order_by_asc("k").limit(7, first=True))
    assert got == [(0, 3), (1, 2), (2, 2)]
