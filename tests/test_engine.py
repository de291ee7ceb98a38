import json
import re

import pytest

from tablemere import Engine, QuerySpec
from tablemere.errors import InvalidQuery
from tablemere.functions.semantics import REFERENCE
from tablemere.sources.sinks import csv_lines, envelope_text, json_lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ten files of 100 rows, by name in order of k."""
    path = str(tmp_path_factory.mktemp("many") / "t")
    spark.range(0, 1000, 1, 10).selectExpr("CAST(id AS INT) AS k", "'v' || id AS v").write.parquet(path)
    return path


@pytest.fixture
def engine(spark, folder):
    made = Engine(spark)
    made.catalog.create_from_parquet("t", folder)
    return made


def ks(df):
    return [r["k"] for r in df.collect()]


def files(df):
    return len(df.inputFiles())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_limits_read_the_first_files_only(engine):
    for df, want in (
        (engine.catalog.preview("t", 10), range(10)), (engine.query(QuerySpec("t").limit(10)), range(10)), (engine.lookup("t", limit=10), range(10)),
        (engine.export("t", 10), range(10)),
    ):
        assert files(df) == 1 and ks(df) == list(want)
    paged = engine.query(QuerySpec("t").limit(20).offset(150))
    assert files(paged) == 2 and ks(paged) == list(range(150, 170))
    found = engine.query(QuerySpec("t").where("k", ">=", 950).limit(5))
    assert files(found) == 10 and ks(found) == list(range(950, 955))
    first = engine.query(QuerySpec("t").aggregate("COUNT", "*", "c").limit(120, first=True))
    assert files(first) == 2 and first.first()["c"] == 120
    assert engine.query(QuerySpec("t", order=()).limit(5000)).count() == 1000


def test_a_row_limit_reads_the_first_files_only(spark, engine, folder):
    engine.catalog.create_from_parquet("few", folder, row_limit=130)
    rows = engine.catalog.rows("few")
    assert files(rows) == 2 and sorted(ks(rows)) == list(range(130))
    assert engine.catalog.preview("few", 5).count() == 5


def test_limits_over_appended_loads(spark, engine, folder):
    engine.catalog.append("t", [(-1, "x")])
    assert engine.catalog.load_parquet("t", folder) == 1000 and engine.catalog.rows("t").count() == 2001
    df = engine.catalog.preview("t", 1003)
    assert files(df) <= 11 and ks(df) == [*range(1000), -1, 0, 1]
    assert ks(engine.catalog.preview("t", 3)) == [0, 1, 2]


def test_only_exports_in_pages_are_sorted(engine):
    whole = engine.export("t")
    assert not re.search("Sort|TakeOrdered|Exchange", plan(whole)) and whole.count() == 1000
    assert ks(engine.export("t", 5, 10)) == list(range(10, 15)) and engine.export("t", offset=990).count() == 10


def test_sql_beyond_the_grammar(spark, folder):
    text = "SELECT count(k) AS n FROM t WHERE k > 5 OR v = 'v1'"
    made = Engine(spark)
    made.catalog.create_from_parquet("t", folder)
    assert made.sql(text).first()["n"] == 995
    with pytest.raises(InvalidQuery):
        made.sql("SELEC k FROM t")
    strict = Engine(spark, REFERENCE)
    strict.catalog.create_from_parquet("t", folder)
    with pytest.raises(InvalidQuery):
        strict.sql(text)


def test_names_of_any_signs(spark):
    df = spark.createDataFrame([(1.5, "x", float("nan"))], "`a.b` double, `c``d` string, `e f` double")
    assert [json.loads(r["line"]) for r in json_lines(df).collect()] == [{"a.b": 1.5, "c`d": "x", "e f": None}]
    assert csv_lines(df).first()["line"] == "1.5,x,NaN"
    made = Engine(spark)
    made.catalog.register("t", df)
    found = made.query(QuerySpec("t", ("a.b", "c`d")).where("c`d", "=", "x").where("a.b", ">", 1))
    assert found.columns == ["a.b", "c`d"] and found.count() == 1
    assert made.query(QuerySpec("t").group_by("c`d").aggregate("SUM", "a.b", "s")).first()["s"] == 1.5


def test_envelope(spark):
    made = json.loads("".join(envelope_text(spark.sql("SELECT 1 AS a, 'x\"y' AS b UNION ALL SELECT NULL, NULL"))))
    assert made["columns"] == ["a", "b"] and made["rowCount"] == 2 and {"a": None, "b": None} in made["rows"]
    assert json.loads("".join(envelope_text(spark.range(0)))) == {"columns": ["id"], "rows": [], "rowCount": 0}


def test_cluster(engine):
    stats, nodes = engine.cluster_stats().first(), engine.nodes().collect()
    assert (stats["node_count"], stats["online_nodes"], stats["offline_nodes"], stats["local_node_id"]) == (len(nodes), len(nodes), 0, "driver")
    assert [n["id"] for n in nodes if n["is_local"]] == ["driver"] and all(n["status"] == "ONLINE" for n in nodes)
