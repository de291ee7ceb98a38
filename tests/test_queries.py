import pytest

from tablemere import Engine, QuerySpec
from tablemere.errors import InvalidQuery, UnknownColumn
from tablemere.plans.sqltext import parsed
from tablemere.streaming import on_stream

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.catalog.create_from_parquet("lineitem", f"{DIR}/lineitem.parquet")
    e.catalog.create_from_parquet("customer", f"{DIR}/customer.parquet")
    return e


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()


def test_front_ends_agree(engine):
    built = (
        QuerySpec("lineitem").select("l_suppkey").where("l_quantity", ">", 10).where("l_discount", ">=", 0.02).group_by("l_suppkey")
        .aggregate("COUNT", "*", "n").aggregate("AVG", "l_extendedprice", "a").order_by_desc("n").limit(20)
    )
    request = {
        "tableName": "lineitem", "columns": ["l_suppkey"], "groupByColumns": ["l_suppkey"], "orderBy": "n", "limit": 20, "distributed": True,
        "aggregateFunctions": {"n": "COUNT", "a": "AVG(l_extendedprice)"},
        "conditions": [
            {"columnName": "l_quantity", "operator": "GREATER_THAN", "value": 10},
            {"columnName": "l_discount", "operator": "GREATER_THAN_OR_EQUALS", "value": 0.02},
        ],
    }
    text = (
        "select l_suppkey, COUNT(*) AS n, avg(l_extendedprice) as a from lineitem where l_quantity > 10 and l_discount >= 0.02 "
        "group by l_suppkey order by n desc limit 20"
    )
    assert QuerySpec.from_json(request) == built == parsed(text)
    assert plan(engine.query(request)) == plan(engine.sql(text)) == plan(engine.query(built))


def test_json_defaults():
    assert QuerySpec.from_json({"tableName": "t", "orderBy": "a"}).order[0].ascending is False
    assert QuerySpec.from_json({"tableName": "t", "page": 3, "limit": 10}).skip == 20
    for bad in ({}, {"tableName": "t", "aggregateFunctions": {"x": "MEDIAN(a)"}}, {"tableName": "t", "conditions": [{"columnName": "a", "operator": "equals"}]}):
        with pytest.raises(InvalidQuery):
            QuerySpec.from_json(bad)


@pytest.mark.parametrize(
    "text", ["SELECT a", "SELECT a FROM", "SELECT a FROM t WHERE a", "SELECT a FROM t LIMIT x", "SELECT a FROM t HAVING a > 1", "SELECT a b FROM t", "SELECT a FROM t WHERE a ~ 1"]
)
def test_sql_refuses(text):
    with pytest.raises(InvalidQuery):
        parsed(text)


def test_sql_reads():
    spec = parsed("SELECT * FROM t WHERE a LIKE 'it''s AND %' AND b IS NOT NULL AND c <> -2.5 AND d = true ORDER BY a, b DESC LIMIT 5 OFFSET 2;")
    assert [(c.column, c.op, c.value) for c in spec.conditions] == [("a", "LIKE", "it's AND %"), ("b", "IS_NOT_NULL", None), ("c", "NOT_EQUALS", -2.5), ("d", "EQUALS", True)]
    assert [(o.column, o.ascending) for o in spec.order] == [("a", True), ("b", False)] and (spec.count, spec.skip) == (5, 2)


def test_spark_sql_beyond_the_grammar(engine):
    got = engine.sql("SELECT count(*) AS n FROM customer c JOIN lineitem l ON c.c_custkey = l.l_suppkey WHERE c.c_custkey = 1 OR 1 = 0")
    assert got.first()["n"] > 0
    assert not engine.spark.catalog.tableExists("customer")
    engine.spark.range(3).createOrReplaceTempView("customer")
    try:
        with pytest.raises(InvalidQuery):
            engine.sql("SELECT count(*) FROM customer, lineitem")
        assert engine.spark.table("customer").count() == 3
    finally:
        engine.spark.catalog.dropTempView("customer")


def test_projection_and_order(engine):
    assert engine.query(QuerySpec("customer", ("c_name", "c_custkey", "c_name"))).columns == ["c_name", "c_custkey"]
    assert engine.query(QuerySpec("customer")).columns == engine.query(QuerySpec("customer", ("*",))).columns
    assert "__row" not in engine.query(QuerySpec("customer")).columns
    with pytest.raises(UnknownColumn):
        engine.query(QuerySpec("customer", ("*", "c_name")))
    got = [r[0] for r in engine.query(QuerySpec("customer", ("c_custkey",)).where("c_custkey", ">", 100).limit(5)).collect()]
    assert got == [101, 102, 103, 104, 105]
    pages = [[r[0] for r in engine.query(QuerySpec("customer", ("c_custkey",)).page(p, 4)).collect()] for p in (1, 2)]
    assert pages[0] + pages[1] == [r[0] for r in engine.query(QuerySpec("customer", ("c_custkey",)).limit(8)).collect()]


def test_ties_and_nulls(spark):
    rows = [(0, None), (1, 2), (2, 1), (3, 2), (4, None), (5, 1)]
    e = Engine(spark)
    e.catalog.register("t", spark.createDataFrame(rows, "i int, v int").coalesce(1))
    q = lambda s: [r[0] for r in e.query(s).collect()]
    assert q(QuerySpec("t", ("i",)).order_by_asc("v").limit(6)) == [0, 4, 2, 5, 1, 3]
    assert q(QuerySpec("t", ("i",)).order_by_desc("v").limit(6)) == [1, 3, 2, 5, 0, 4]
    assert q(QuerySpec("t", ("i",)).limit(0)) == q(QuerySpec("t", ("i",)).limit(-3)) == [0, 1, 2, 3, 4, 5]


def test_case_sensitive_names(spark):
    e = Engine(spark)
    e.catalog.create("t", [("a", "integer", True)])
    with pytest.raises(UnknownColumn):
        e.query(QuerySpec("t", ("A",)))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"x{i}") for i in range(10)], "i int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, s string").parquet(str(tmp_path / "in"))
    found = on_stream(stream, QuerySpec("t", ("s",)).where("i", ">=", 7))
    q = found.writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["s"] for r in spark.table("found").collect()) == ["x7", "x8", "x9"]
    with pytest.raises(InvalidQuery):
        on_stream(stream, QuerySpec("t").limit(3))
