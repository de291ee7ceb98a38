"""The engine's own queries, each with SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemere.engine import Engine, per_shard_limit, union_of
from tablemere.errors import EngineError
from tablemere.functions.semantics import ANSI, REFERENCE, Semantics
from tablemere.operators.aggregates import wrapped_long
from tablemere.plans.spec import QuerySpec
from tablemere.sources.rows import POSITION, hidden, scan
from tablemere.sources.sinks import csv_lines, envelope_text, json_lines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

FLAGSHIP_SQL = (
    "SELECT l_suppkey, COUNT(*) AS trip_count, ROUND(AVG(l_extendedprice), 4) AS avg_fare FROM lineitem "
    "WHERE l_quantity > 10 AND l_discount >= 0.02 GROUP BY l_suppkey ORDER BY trip_count DESC, l_suppkey LIMIT 20"
)


def _query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        name = f.__name__.lstrip("_")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def _rows(spark: SparkSession, sf_dir: str, table: str, **derived: Column) -> DataFrame:
    """A table's rows with positions; ``derived`` columns are added or replaced."""
    return scan(spark, f"{sf_dir}/{table}.parquet").withColumns(derived)


def _run(rows: DataFrame, spec: QuerySpec, semantics: Semantics = ANSI, plain: DataFrame | None = None) -> DataFrame:
    engine = Engine(rows.sparkSession, semantics)
    engine.catalog.register(spec.table, rows if plain is None else plain, rows)
    return engine.query(spec)


def _on(spark: SparkSession, sf_dir: str, spec: QuerySpec, semantics: Semantics = ANSI, **derived: Column) -> DataFrame:
    plain = spark.read.parquet(f"{sf_dir}/{spec.table}.parquet").withColumns(derived)
    return _run(_rows(spark, sf_dir, spec.table, **derived), spec, semantics, plain)


def _q(table: str, *columns: str) -> QuerySpec:
    return QuerySpec(table, columns)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _priority() -> Column:
    return F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))


# scans, projections, filters


@_query("SELECT * FROM nation")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("nation", "*"))


@_query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def filter_int_gt(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey", "p_size").where("p_size", ">", 25))


@_query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15 AND p_size > 9 AND p_size < 21")
def filter_int_ops(spark: SparkSession, d: str) -> DataFrame:
    spec = _q("part", "p_partkey", "p_size").where("p_size", ">=", 10).where("p_size", "<=", 20).where("p_size", "<>", 15)
    return _on(spark, d, spec.where("p_size", ">", 9).where("p_size", "<", 21))


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 899")
def filter_long_eq(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "o_custkey").where("o_custkey", "=", 899))


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1863.84")
def filter_double_le(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("customer", "c_custkey", "c_acctbal").where("c_acctbal", "<=", 1863.84))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def filter_string_eq(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey").where("o_orderstatus", "=", "P"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def filter_string_ne(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey").where("o_orderstatus", "!=", "P"))


@_query("SELECT doc_id, toxic=1 AS is_toxic FROM labels WHERE (toxic=1)=true")
def filter_bool(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("labels", "doc_id", "is_toxic").where("is_toxic", "=", True), is_toxic=F.col("toxic") == 1)


@_query("SELECT vec_id, CAST(embedding[1] AS FLOAT) AS e0 FROM embeddings WHERE CAST(embedding[1] AS FLOAT) < CAST(0.1 AS FLOAT)")
def filter_float32(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("float").alias("e0"), *POSITION)
    return _run(rows, _q("embeddings", "vec_id", "e0").where("e0", "<", 0.1))


@_query("SELECT p_partkey FROM part WHERE p_size = CAST(trunc(10.9) AS INTEGER)")
def filter_int_narrowed(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_size", "=", 10.9))


@_query("SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE epoch_us(ts) >= 1704153600000000")
def filter_ts_micros(spark: SparkSession, d: str) -> DataFrame:
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return _on(spark, d, _q("events", "event_id", "ts_us").where("ts_us", ">=", 1704153600000000), ts_us=micros)


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def filter_ts_native(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "o_orderdate").where("o_orderdate", ">=", 883612800000))


@_query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def like_percent(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey", "p_name").where("p_name", "LIKE", "%ring%"))


@_query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#.')")
def like_reference_regex(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_brand", "LIKE", "Brand#_"), REFERENCE)


@_query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderpriority,'5-LOW') AS p FROM orders) WHERE p IS NULL")
def is_null(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey").where("p", "IS NULL"), p=_priority())


@_query("SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority,'5-LOW') AS p FROM orders) WHERE p IS NOT NULL")
def is_not_null(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "p").where("p", "IS NOT NULL"), p=_priority())


@_query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderpriority,'5-LOW') AS p FROM orders) WHERE p <> '1-URGENT'")
def ne_skips_null(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey").where("p", "!=", "1-URGENT"), p=_priority())


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A' AND l_linestatus = 'F'")
def conjunction(spark: SparkSession, d: str) -> DataFrame:
    spec = _q("lineitem", "l_orderkey", "l_linenumber").where("l_quantity", ">", 30.0)
    return _on(spark, d, spec.where("l_returnflag", "=", "A").where("l_linestatus", "=", "F"))


@_query("SELECT * FROM part WHERE CAST(p_retailprice AS VARCHAR)='900.0'")
def text_equality(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("part", f"{d}/part.parquet")
    return engine.lookup("part", "p_retailprice", "900.0", limit=0)


# limits and pages


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 LIMIT 50")
def limit_insertion_order(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "o_totalprice").where("o_totalprice", ">", 100000).limit(50))


@_query("SELECT c_custkey FROM customer LIMIT 10 OFFSET 20")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("customer", "c_custkey").limit(10).offset(20))


@_query("SELECT c_custkey, c_name FROM customer LIMIT 10 OFFSET 10")
def page_2(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("customer", "c_custkey", "c_name").page(2, 10))


@_query("SELECT p_partkey, p_name FROM part LIMIT 10")
def preview_10(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("part", f"{d}/part.parquet")
    return engine.catalog.preview("part", 10).select("p_partkey", "p_name")


@_query("SELECT s, COUNT(*) AS c FROM (SELECT o_orderstatus s FROM orders LIMIT 500) GROUP BY 1")
def limit_before_group(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("orders").group_by("s").aggregate("COUNT", "*", "c").limit(500, first=True)
    return _on(spark, d, spec, s=F.col("o_orderstatus"))


# aggregates


@_query("SELECT l_returnflag, round(SUM(l_quantity),2) AS s FROM lineitem GROUP BY 1")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_on(spark, d, QuerySpec("lineitem").group_by("l_returnflag").aggregate("SUM", "l_quantity", "s")), 2, "s")


@_query("SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY 1,2")
def group_multi_key(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("lineitem").group_by("l_returnflag", "l_linestatus").aggregate("COUNT", "*", "c"))


@_query("SELECT p, COUNT(*) AS c FROM (SELECT nullif(o_orderpriority,'5-LOW') AS p FROM orders) GROUP BY 1")
def group_null_key(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("orders").group_by("p").aggregate("COUNT", "*", "c"), p=_priority())


@_query("SELECT l_returnflag, MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx FROM lineitem GROUP BY 1")
def min_max_num(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("lineitem").group_by("l_returnflag").aggregate("MIN", "l_extendedprice", "mn")
    return _on(spark, d, spec.aggregate("MAX", "l_extendedprice", "mx"))


@_query("SELECT MIN(c_name) AS mn, MAX(c_name) AS mx FROM customer")
def min_max_string(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("customer").aggregate("MIN", "c_name", "mn").aggregate("MAX", "c_name", "mx"))


@_query(
    "SELECT COUNT(*) AS c, CAST(SUM(p_size) AS BIGINT) AS s, ROUND(AVG(p_size),6) AS a, MIN(p_size) AS mn, MAX(p_size) AS mx FROM part"
)
def global_all_aggs(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("part").aggregate("COUNT", "p_size", "c").aggregate("SUM", "p_size", "s").aggregate("AVG", "p_size", "a")
    return _rounded(_on(spark, d, spec.aggregate("MIN", "p_size", "mn").aggregate("MAX", "p_size", "mx")), 6, "a")


@_query(
    "SELECT CAST(((SUM(CAST(p_size AS BIGINT)*100000) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS s FROM part"
)
def sum_int32_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("part").aggregate("SUM", "v", "s"), REFERENCE, v=F.col("p_size") * 100000)


@_query(
    "SELECT (((SUM(CAST(p_size AS BIGINT)*100000) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) / CAST(COUNT(*) AS DOUBLE) AS a FROM part"
)
def avg_int_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("part").aggregate("AVG", "v", "a"), REFERENCE, v=F.col("p_size") * 100000)


@_query(
    "SELECT o_orderstatus, round(coalesce(SUM(v),0)/COUNT(*),4) AS a FROM (SELECT o_orderstatus, "
    "CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE o_totalprice END v FROM orders) GROUP BY 1"
)
def avg_all_rows(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    spec = QuerySpec("orders").group_by("o_orderstatus").aggregate("AVG", "v", "a")
    return _rounded(_on(spark, d, spec, REFERENCE, v=value), 4, "a")


@_query("SELECT n_regionkey, coalesce(min(nullif(n_name,n_name)),'') AS m FROM nation GROUP BY 1")
def min_all_null_default(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("nation").group_by("n_regionkey").aggregate("MIN", "v", "m")
    return _on(spark, d, spec, REFERENCE, v=F.nullif(F.col("n_name"), F.col("n_name")))


@_query("SELECT COUNT(*) AS c FROM (SELECT nullif(o_orderstatus,'P') x FROM orders)")
def count_includes_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("orders").aggregate("COUNT", "x", "c"), REFERENCE, x=F.nullif(F.col("o_orderstatus"), F.lit("P")))


@_query("SELECT CASE WHEN COUNT(*)=0 THEN NULL ELSE COUNT(*) END AS c FROM orders WHERE o_totalprice < -1")
def count_empty_null(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("orders").where("o_totalprice", "<", -1).aggregate("COUNT", "o_orderkey", "c"), REFERENCE)


@_query(
    "SELECT COUNT(v) AS c, CAST(SUM(v) AS BIGINT) AS s, ROUND(AVG(v),6) AS a, MIN(v) AS mn FROM (SELECT nullif(p_size,11) v FROM part)"
)
def ansi_null_aggs(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("part").aggregate("COUNT", "v", "c").aggregate("SUM", "v", "s").aggregate("AVG", "v", "a").aggregate("MIN", "v", "mn")
    return _rounded(_on(spark, d, spec, v=F.nullif(F.col("p_size"), F.lit(11))), 6, "a")


@_query("SELECT MIN(nullif(n_name,n_name)) AS m, COUNT(*) AS c FROM nation")
def ansi_all_null_min(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("nation").aggregate("MIN", "v", "m").aggregate("COUNT", "*", "c")
    return _on(spark, d, spec, v=F.nullif(F.col("n_name"), F.col("n_name")))


@_query(FLAGSHIP_SQL)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    request = {
        "tableName": "lineitem",
        "columns": ["l_suppkey"],
        "conditions": [
            {"columnName": "l_quantity", "operator": "GREATER_THAN", "value": 10},
            {"columnName": "l_discount", "operator": "GREATER_THAN_OR_EQUALS", "value": 0.02},
        ],
        "groupByColumns": ["l_suppkey"],
        "aggregateFunctions": {"trip_count": "COUNT", "avg_fare": "AVG(l_extendedprice)"},
        "orderBy": "trip_count",
        "orderByAscending": False,
        "limit": 20,
    }
    return _rounded(_on(spark, d, QuerySpec.from_json(request).order_by_asc("l_suppkey")), 4, "avg_fare")


@_query(FLAGSHIP_SQL)
def flagship_sql(spark: SparkSession, d: str) -> DataFrame:
    """The flagship as SQL text of the single-table grammar."""
    engine = Engine(spark)
    engine.catalog.create_from_parquet("lineitem", f"{d}/lineitem.parquet")
    return _rounded(engine.sql(FLAGSHIP_SQL.replace("ROUND(AVG(l_extendedprice), 4)", "AVG(l_extendedprice)")), 4, "avg_fare")


@_query("SELECT COUNT(*) AS row_count, CAST(SUM(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, COUNT(x) AS non_null_count FROM (SELECT nullif(o_orderstatus,'P') x FROM orders)")
def null_stats(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.register("orders", _rows(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("x"), *POSITION))
    return engine.catalog.stats("orders").select("row_count", "null_count", "non_null_count")


# sorting and shards


@_query("SELECT c_nationkey, COUNT(*) AS c FROM customer GROUP BY 1 ORDER BY c DESC, c_nationkey LIMIT 20")
def group_order_limit(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec("customer").group_by("c_nationkey").aggregate("COUNT", "*", "c")
    return _on(spark, d, spec.order_by_desc("c").order_by_asc("c_nationkey").limit(20))


@_query("SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority,'5-LOW') p FROM orders) ORDER BY p ASC NULLS FIRST, o_orderkey LIMIT 25")
def order_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "p").order_by_asc("p").order_by_asc("o_orderkey").limit(25), p=_priority())


@_query("SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority,'5-LOW') p FROM orders) ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 25")
def order_nulls_last_desc(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("orders", "o_orderkey", "p").order_by_desc("p").order_by_asc("o_orderkey").limit(25), p=_priority())


@_query("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey ASC LIMIT 30")
def order_multi(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("customer", "c_nationkey", "c_custkey").order_by_desc("c_nationkey").order_by_asc("c_custkey").limit(30))


def _shards(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = _rows(spark, d, "customer", k=F.col("c_custkey"))
    return [rows.where(F.col("c_custkey") % 2 == r).select("k", *POSITION) for r in (0, 1)]


@_query("SELECT c_custkey k FROM (SELECT * FROM customer WHERE c_custkey%2=0) UNION ALL SELECT c_custkey FROM customer WHERE c_custkey%2=1 ORDER BY k DESC LIMIT 7")
def shard_union_topk(spark: SparkSession, d: str) -> DataFrame:
    return _run(union_of(_shards(spark, d)), _q("shards", "k").order_by_desc("k").limit(7))


@_query("SELECT k FROM ((SELECT c_custkey k FROM customer WHERE c_custkey%2=0 LIMIT 7) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey%2=1 LIMIT 7)) ORDER BY k DESC LIMIT 7")
def shard_unsorted_limit(spark: SparkSession, d: str) -> DataFrame:
    return hidden(per_shard_limit(_shards(spark, d), 7, [F.col("k").desc()]))


# loading, catalog, output


@_query("SELECT COUNT(*) AS c FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)")
def load_append(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("nation", f"{d}/nation.parquet")
    engine.catalog.load_parquet("nation", f"{d}/nation.parquet")
    return engine.query(QuerySpec("nation").aggregate("COUNT", "*", "c"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation LIMIT 7")
def load_row_limit(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("nation", f"{d}/nation.parquet", row_limit=7)
    return engine.query(_q("nation"))


@_query("SELECT COUNT(*) AS c FROM nation WHERE 1 = 0")
def schema_only(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_schema_from_parquet("nation", f"{d}/nation.parquet")
    return engine.query(QuerySpec("nation").aggregate("COUNT", "*", "c"))


@_query(
    "SELECT CAST(position AS INTEGER) AS position, name, type, repetition FROM (VALUES (0, 'n_nationkey', 'INT32', 'OPTIONAL'), "
    "(1, 'n_name', 'BINARY', 'OPTIONAL'), (2, 'n_regionkey', 'INT32', 'OPTIONAL')) AS t(position, name, type, repetition)"
)
def parquet_inspect(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).inspect(f"{d}/nation.parquet")


@_query(
    "SELECT \"table\", CAST(position AS INTEGER) AS position, name, type, nullable FROM (VALUES ('nation', 0, 'n_nationkey', 'INTEGER', true), "
    "('nation', 1, 'n_name', 'STRING', true), ('nation', 2, 'n_regionkey', 'INTEGER', true), ('region', 0, 'r_regionkey', 'INTEGER', true), "
    "('region', 1, 'r_name', 'STRING', true)) AS t(\"table\", position, name, type, nullable)"
)
def catalog_list(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    for t in ("region", "nation"):
        engine.catalog.create_from_parquet(t, f"{d}/{t}.parquet")
    return engine.catalog.describe()


@_query("SELECT concat_ws(',', coalesce(CAST(p_partkey AS VARCHAR),''), CASE WHEN regexp_matches(p_name,'[,\"\\n\\r]') THEN '\"'||replace(p_name,'\"','\"\"')||'\"' ELSE p_name END) AS line FROM part")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    return csv_lines(_on(spark, d, _q("part", "p_partkey", "p_name")))


@_query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    return json_lines(_on(spark, d, _q("nation")))


@_query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 3 LIMIT 10 OFFSET 5")
def export_filtered(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.register("customer", _rows(spark, d, "customer").select("c_custkey", "c_nationkey", *POSITION))
    return engine.export("customer", 10, 5, [{"columnName": "c_nationkey", "operator": "EQUALS", "value": 3}])


@_query("SELECT 'UP' AS status, CAST(1 AS BIGINT) AS n")
def cluster_status(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).cluster().groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# conditions that nothing satisfies, and what only the reproduced semantics has


@_query("SELECT p_partkey FROM part WHERE 1 = 0")
def filter_null_literal(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_size", "=", None))


@_query("SELECT p_partkey FROM part WHERE 1 = 0")
def lenient_literal(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_size", "=", "25"), REFERENCE)


@_query("SELECT p_partkey FROM part WHERE 1 = 0")
def lenient_operator(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_name", "<", "m"), REFERENCE)


@_query("SELECT p_partkey FROM part WHERE 1 = 0")
def like_bad_regex(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, _q("part", "p_partkey").where("p_name", "LIKE", "("), REFERENCE)


@_query("SELECT p_partkey FROM part WHERE p_size <= 25 AND p_retailprice > 1000")
def nan_is_not_greater(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_size") > 25, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return _on(spark, d, _q("part", "p_partkey").where("v", ">", 1000), REFERENCE, v=value)


@_query(
    "SELECT CAST(((SUM(CAST(o_custkey AS HUGEINT)*100000000000000) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) "
    "% 18446744073709551616 - 9223372036854775808 AS BIGINT) AS s FROM orders"
)
def sum_int64_wrap(spark: SparkSession, d: str) -> DataFrame:
    product = F.col("o_custkey").cast("decimal(19,0)") * 100_000_000_000_000  # beyond a LONG from key 92,234 on
    return _on(spark, d, QuerySpec("orders").aggregate("SUM", "v", "s"), REFERENCE, v=wrapped_long(product))


@_query("SELECT * FROM region WHERE 1 = 0")
def lookup_unknown_column(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("region", f"{d}/region.parquet")
    return engine.lookup("region", "no_such_column", "1")


@_query('SELECT n_regionkey, COUNT(*) AS "COUNT(*)", MIN(n_name) AS "MIN(n_name)" FROM nation GROUP BY 1')
def group_default_names(spark: SparkSession, d: str) -> DataFrame:
    return _on(spark, d, QuerySpec("nation").group_by("n_regionkey").aggregate("COUNT", "*").aggregate("MIN", "n_name"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 10 ORDER BY c_custkey DESC LIMIT 5 OFFSET 5")
def json_page(spark: SparkSession, d: str) -> DataFrame:
    request = {
        "tableName": "customer", "columns": ["c_custkey", "c_name", "c_custkey"], "orderBy": "c_custkey", "limit": 5, "page": 2,
        "conditions": [{"columnName": "c_nationkey", "operator": "GREATER_THAN_OR_EQUALS", "value": 10}],
    }
    return _on(spark, d, QuerySpec.from_json(request))


@_query("SELECT p_partkey, p_brand FROM part WHERE p_name LIKE '%ring%' AND p_size <> 15 AND p_type IS NOT NULL ORDER BY p_partkey LIMIT 12")
def sql_conditions(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("part", f"{d}/part.parquet")
    return engine.sql("select p_partkey, p_brand from part where p_name like '%ring%' and p_size <> 15 and p_type is not null order by p_partkey limit 12")


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', NULL")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("nation", f"{d}/nation.parquet")
    engine.catalog.append("nation", [(99, "NOWHERE", None)])
    return engine.query(_q("nation"))


@_query("SELECT r_regionkey AS id, r_name AS label FROM region")
def load_by_place(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create("names", [("id", "INTEGER"), ("label", "STRING")])
    engine.catalog.load_parquet("names", f"{d}/region.parquet")
    return engine.query(_q("names"))


@_query("SELECT epoch_us(o_orderdate) AS day, COUNT(*) AS c FROM orders GROUP BY 1")
def load_timestamps_as_numbers(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    columns = [("o_orderkey", "LONG", True), ("o_custkey", "LONG", True), ("o_orderstatus", "STRING", True), ("o_totalprice", "DOUBLE", True), ("day", "LONG", True), ("o_orderpriority", "STRING", True)]
    engine.catalog.create("orders", columns)
    engine.catalog.load_parquet("orders", f"{d}/orders.parquet")
    return engine.query(QuerySpec("orders").group_by("day").aggregate("COUNT", "*", "c"))


@_query("SELECT 'n_nationkey,n_name,n_regionkey' AS names, COUNT(*) AS row_count, COUNT(n_name) AS rows FROM nation")
def result_envelope(spark: SparkSession, d: str) -> DataFrame:
    made = json.loads("".join(envelope_text(_on(spark, d, _q("nation")))))
    row = (",".join(made["columns"]), made["rowCount"], sum(r["n_name"] is not None for r in made["rows"]))
    return spark.createDataFrame([row], "names string, row_count long, rows long")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 4")
def lookup_limit(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_from_parquet("customer", f"{d}/customer.parquet")
    return engine.lookup("customer", "c_nationkey", "3", limit=4).select("c_custkey", "c_name")


@_query("SELECT * FROM (VALUES ('created', true, 5), ('dropped', false, 0)) AS t(step, there, rows)")
def drop_and_exists(spark: SparkSession, d: str) -> DataFrame:
    catalog, found = Engine(spark).catalog, []
    catalog.create_from_parquet("region", f"{d}/region.parquet")
    found.append(("created", catalog.exists("region"), catalog.rows("region").count()))
    catalog.drop("region")
    found.append(("dropped", catalog.exists("region"), 0))
    return spark.createDataFrame(found, "step string, there boolean, rows int")


@_query(
    "SELECT p_partkey || ',' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '\"' || p_name || ', \"\"' || p_brand || '\"\"\"' ELSE p_name END "
    "|| ',' || p_size AS line FROM part"
)
def csv_quotes_and_nulls(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("p_partkey") % 3
    name = F.when(third == 1, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(third == 2, F.col("p_name"))
    return csv_lines(_on(spark, d, _q("part", "p_partkey", "text", "p_size"), text=name))


@_query(r"""SELECT '{"n_nationkey":' || n_nationkey || ',"text":"' || n_name || '\"\\\n\t/","none":null}' AS line FROM nation""")
def json_escapes(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("n_name", F.lit('"\\\n\t/'))
    return json_lines(_on(spark, d, _q("nation", "n_nationkey", "text", "none"), text=text, none=F.lit(None).cast("string")))


@_query("SELECT * FROM (VALUES ('aggregate', 'UnsupportedType'), ('bare column', 'InvalidQuery'), ('column', 'UnknownColumn'), ('condition', 'UnknownColumn')) AS t(request, refused)")
def refused_requests(spark: SparkSession, d: str) -> DataFrame:
    requests = {
        "column": _q("nation", "n_none"), "condition": _q("nation").where("n_none", "=", 1),
        "aggregate": QuerySpec("nation").aggregate("SUM", "n_name", "s"), "bare column": _q("nation", "n_name").aggregate("COUNT", "*", "c"),
    }
    found = []
    for name, spec in requests.items():
        try:
            _on(spark, d, spec)
        except EngineError as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "request string, refused string")


@_query("SELECT COUNT(*) AS c FROM nation")
def load_with_batch_size(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.create_schema_from_parquet("nation", f"{d}/nation.parquet")
    engine.catalog.load_parquet("nation", f"{d}/nation.parquet", batch_size=3)
    return engine.query(QuerySpec("nation").aggregate("COUNT", "*", "c"))


#: Operators as JSON requests and as SQL have them.
_COMPARED = {"EQUALS": "=", "NOT_EQUALS": "<>", "LESS_THAN": "<", "LESS_THAN_OR_EQUALS": "<=", "GREATER_THAN": ">", "GREATER_THAN_OR_EQUALS": ">="}


def _each_operator(spark: SparkSession, d: str, table: str, column: str, value: object, **derived: Column) -> DataFrame:
    """(op, c): the rows that satisfy each comparison with a value."""
    found = [
        _on(spark, d, QuerySpec(table).where(column, op, value).aggregate("COUNT", "*", "c"), **derived).select(F.lit(op).alias("op"), "c") for op in _COMPARED
    ]
    return union_of(found)


def _each_sql(table: str, column: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{op}' AS op, COUNT(*) AS c FROM {table} WHERE {column} {sign} {value}" for op, sign in _COMPARED.items())


@_query(_each_sql("orders", "o_custkey", "70"))
def compare_long(spark: SparkSession, d: str) -> DataFrame:
    return _each_operator(spark, d, "orders", "o_custkey", 70)


@_query(_each_sql("part", "CAST(p_retailprice AS FLOAT)", "CAST(950.5 AS FLOAT)"))
def compare_float(spark: SparkSession, d: str) -> DataFrame:
    return _each_operator(spark, d, "part", "price", 950.5, price=F.col("p_retailprice").cast("float"))


@_query(_each_sql("orders", "o_orderdate", "TIMESTAMP '1996-01-02 00:00:00'"))
def compare_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return _each_operator(spark, d, "orders", "o_orderdate", 820540800000)


@_query(_each_sql("orders", "CAST(o_orderdate AS DATE)", "DATE '1996-01-02'"))
def compare_date(spark: SparkSession, d: str) -> DataFrame:
    return _each_operator(spark, d, "orders", "day", "1996-01-02", day=F.col("o_orderdate").cast("date"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
