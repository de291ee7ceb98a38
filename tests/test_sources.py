import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablemere import Engine, QuerySpec
from tablemere.errors import EngineError, InvalidDefinition, SchemaMismatch, TableExists, TableNotFound, UnsupportedType
from tablemere.sources.sinks import csv_text, json_text, text_table, write_csv, write_json

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def engine(spark):
    return Engine(spark)


def count(engine, name):
    return engine.query(QuerySpec(name).aggregate("COUNT", "*", "n")).first()["n"]


def test_definitions(engine):
    engine.catalog.create("users", [{"name": "id", "type": "INTEGER"}, {"name": "name", "type": "string", "nullable": True}])
    assert [tuple(r) for r in engine.catalog.describe("users").collect()] == [("users", 0, "id", "INTEGER", False), ("users", 1, "name", "STRING", True)]
    assert engine.catalog.exists("users") and not engine.catalog.exists("Users")
    for bad in ([("a", "blob")], [], [("a", "LONG"), ("a", "LONG")], [("__row", "LONG")]):
        with pytest.raises(InvalidDefinition):
            engine.catalog.create("other", bad)
    with pytest.raises(TableExists):
        engine.catalog.create("users", [("a", "LONG")])
    engine.catalog.drop("users")
    for act in (engine.catalog.drop, engine.catalog.get, engine.catalog.describe, engine.catalog.stats, engine.catalog.preview):
        with pytest.raises(TableNotFound):
            act("users")


def test_loads(engine):
    assert [c.nullable for c in engine.catalog.create_from_parquet("nation", f"{DIR}/nation.parquet").columns] == [True] * 3
    assert engine.catalog.load_parquet("nation", f"{DIR}/nation.parquet", row_limit=5, batch_size=100) == 5
    assert count(engine, "nation") == 30
    got = [r["n_nationkey"] for r in engine.query(QuerySpec("nation", ("n_nationkey",)).offset(23).limit(4)).collect()]
    assert got == [23, 24, 0, 1]
    engine.catalog.create_schema_from_parquet("empty", f"{DIR}/nation.parquet")
    assert count(engine, "empty") == 0
    with pytest.raises(TableExists):
        engine.catalog.create_from_parquet("nation", f"{DIR}/region.parquet")
    with pytest.raises(EngineError):
        engine.catalog.create_from_parquet("none", f"{DIR}/none.parquet")
    assert not engine.catalog.exists("none")
    with pytest.raises(UnsupportedType):
        engine.catalog.create_from_parquet("embeddings", f"{DIR}/embeddings.parquet")


def test_fit_is_by_place(engine, tmp_path):
    write = lambda name, **cols: pq.write_table(pa.table(cols), tmp_path / name)
    write("same.parquet", x=pa.array([1, 2], pa.int32()), y=["a", None])
    write("fewer.parquet", x=pa.array([1], pa.int32()))
    write("other.parquet", x=pa.array([1], pa.int64()), y=["a"])
    engine.catalog.create("t", [("id", "INTEGER"), ("s", "STRING", True)])
    assert engine.catalog.load_parquet("t", str(tmp_path / "same.parquet")) == 2
    for name in ("fewer", "other"):
        with pytest.raises(SchemaMismatch):
            engine.catalog.load_parquet("t", str(tmp_path / f"{name}.parquet"))
    engine.catalog.create("strict", [("id", "INTEGER"), ("s", "STRING")])
    with pytest.raises(SchemaMismatch):
        engine.catalog.load_parquet("strict", str(tmp_path / "same.parquet"))
    assert count(engine, "strict") == 0
    assert engine.catalog.append("t", [(3, "c"), (4, None)]) == 2
    assert [tuple(r) for r in engine.catalog.preview("t").collect()] == [(1, "a"), (2, None), (3, "c"), (4, None)]
    assert engine.catalog.preview("t", 0).count() == 0
    with pytest.raises(SchemaMismatch):
        engine.catalog.append("t", [(1,)])


def test_required_and_old_timestamps(engine, spark, tmp_path):
    schema = pa.schema([pa.field("a", pa.int64(), nullable=False), pa.field("b", pa.timestamp("us"))])
    pq.write_table(pa.table([[1], [dt.datetime(2024, 1, 1)]], schema=schema), tmp_path / "r.parquet")
    table = engine.catalog.create_from_parquet("r", str(tmp_path / "r.parquet"))
    assert [(c.type, c.nullable) for c in table.columns] == [("LONG", False), ("TIMESTAMP", True)]
    assert [tuple(r)[1:] for r in engine.inspect(str(tmp_path / "r.parquet")).orderBy("position").collect()] == [("a", "INT64", "REQUIRED"), ("b", "INT64", "OPTIONAL")]
    engine.catalog.create("raw", [("a", "LONG"), ("b", "LONG")])
    engine.catalog.load_parquet("raw", str(tmp_path / "r.parquet"))
    assert engine.catalog.rows("raw").first()["b"] == 1704067200000000
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").write.parquet(str(tmp_path / "old"))
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    engine.catalog.create_from_parquet("old", str(tmp_path / "old"))
    assert engine.query(QuerySpec("old").where("t", "=", 1704067200000)).count() == 1


def test_stats(engine, spark):
    engine.catalog.register("t", spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string"))
    got = {r["name"]: (r["row_count"], r["null_count"], r["non_null_count"]) for r in engine.catalog.stats("t").collect()}
    assert got == {"a": (3, 1, 2), "b": (3, 2, 1)}


TEXTS = ["a,b", 'say "hi"', "two\nlines", "cr\rhere", "tab\there", "back\\slash", " edge ", "#", "", None, "été", "1.0"]


def test_csv_and_json(engine, spark, tmp_path):
    df = spark.createDataFrame([(i, t, None if t is None else i / 3) for i, t in enumerate(TEXTS)], "i int, t string, d double").coalesce(1)
    engine.catalog.register("t", df)
    quote = lambda t: "" if t is None else '"' + t.replace('"', '""') + '"' if set(t) & set(',"\n\r') else t
    want = ["i,t,d\n"] + [f"{i},{quote(t)},{'' if t is None else i / 3}\n" for i, t in enumerate(TEXTS)]
    assert list(csv_text(engine.export("t"))) == want
    write_csv(engine.catalog.rows("t"), str(tmp_path / "csv"), single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes().decode() == "".join(want)
    objects = json.loads("".join(json_text(engine.export("t"))))
    assert [o["t"] for o in objects] == TEXTS and list(objects[0]) == ["i", "t", "d"]
    write_json(engine.catalog.rows("t"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(TEXTS)
    assert json.loads("".join(json_text(engine.export("t", conditions=[{"columnName": "i", "operator": "LESS_THAN", "value": 0}])))) == []
    assert [r["i"] for r in engine.export("t", 2, 3).collect()] == [3, 4]
    assert json.loads("".join(json_text(spark.sql("SELECT double('NaN') AS x, true AS b")))) == [{"x": None, "b": True}]


def test_text_table_and_lookup(engine, spark):
    engine.catalog.register("t", spark.createDataFrame([(1, None), (25, True)], "age int, ok boolean").coalesce(1))
    assert text_table(engine.catalog.rows("t")) == "age  ok\n-----------\n1    NULL\n25   true"
    assert text_table(engine.catalog.preview("t", 0)) == "(empty result)"
    assert [r["age"] for r in engine.lookup("t", "age", "25").collect()] == [25]
    assert engine.lookup("t", "none", "1").count() == 0 and engine.lookup("t", limit=1).count() == 1
    assert engine.cluster().first()["status"] == "UP" and engine.nodes().count() >= 1
