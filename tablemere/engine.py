"""The engine: a catalog of tables and the queries on them."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemere.errors import InvalidQuery
from tablemere.functions.semantics import ANSI, Semantics
from tablemere.operators.predicates import text_equals
from tablemere.plans.compile import compiled, filtered
from tablemere.plans.spec import Condition, QuerySpec
from tablemere.plans.sqltext import parsed
from tablemere.sources import parquet
from tablemere.sources.catalog import Catalog
from tablemere.sources.rows import hidden, in_order, visible


class Engine:
    """Queries over a catalog. Every result is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, semantics: Semantics = ANSI) -> None:
        self.spark, self.semantics, self.catalog = spark, semantics, Catalog(spark)

    def query(self, spec: QuerySpec | dict) -> DataFrame:
        """The result of a QuerySpec or of a JSON request."""
        spec = QuerySpec.from_json(spec) if isinstance(spec, dict) else spec
        table = self.catalog.get(spec.table)
        if spec.count <= 0 and spec.skip <= 0:
            return compiled(table.plain, spec, self.semantics)
        # a cut that nothing comes before is of the first rows
        first = spec.count > 0 and not spec.conditions and (spec.limit_first or not (spec.order or spec.groups or spec.aggregates))
        return compiled(table.head(spec.skip + spec.count) if first else table.rows, spec, self.semantics)

    def sql(self, text: str) -> DataFrame:
        """The result of SQL: the single-table grammar by QuerySpec; under ANSI anything else by Spark on the catalog's tables.

        Other semantics refuse SQL beyond the grammar, for Spark would run it by ANSI's.
        """
        try:
            spec = parsed(text)
        except InvalidQuery:
            if self.semantics != ANSI:
                raise
            # a view for each table while the text is analysed; the session's own views are left alone
            named = {n: self.catalog.rows(n) for n in self.catalog.names() if n.isidentifier()}
            own = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
            if taken := [n for n in named if n.lower() in own]:
                raise InvalidQuery(f"{taken[0]!r} is also a temporary view of the session") from None
            for n, df in named.items():
                df.createOrReplaceTempView(n)
            try:
                return self.spark.sql(text)
            except AnalysisException as e:  # ParseException is one
                raise InvalidQuery(str(e).partition("\n")[0]) from e
            finally:
                for n in named:
                    self.spark.catalog.dropTempView(n)
        return self.query(spec)

    def lookup(self, table: str, column: str | None = None, value: str | None = None, limit: int = 100) -> DataFrame:
        """Rows whose cell, as text, is ``value``; a column that the table lacks has no such row."""
        found = column is not None and value is not None
        rows = self.catalog.rows(table) if limit <= 0 else self.catalog.get(table).rows if found else self.catalog.get(table).head(limit)
        if found:
            rows = rows.where(text_equals(column, value)) if column in visible(rows) else rows.limit(0)
        if limit > 0:
            rows = rows.orderBy(*in_order()).limit(limit)
        return hidden(rows)

    def export(self, table: str, limit: int = -1, offset: int = 0, conditions: tuple[Condition, ...] | list[dict] = ()) -> DataFrame:
        """Rows [offset, offset + limit) in order of loading, of those that satisfy the conditions; limit 0 or less: to the end.

        Without limit and offset all rows, in no order.
        """
        found = tuple(Condition.from_json(c) if isinstance(c, dict) else c for c in conditions)
        own = self.catalog.get(table)
        if limit <= 0 and offset <= 0:  # whole exports need no order
            return filtered(own.plain, QuerySpec(table, conditions=found), self.semantics)
        rows = own.head(limit + max(0, offset)) if limit > 0 and not found else own.rows
        rows = filtered(rows, QuerySpec(table, conditions=found), self.semantics).orderBy(*in_order())
        if offset > 0:
            rows = rows.offset(offset)
        return hidden(rows.limit(limit) if limit > 0 else rows)

    def inspect(self, path: str) -> DataFrame:
        """Fields of a Parquet file."""
        return parquet.inspect(self.spark, path)

    def cluster(self) -> DataFrame:
        """One row about the running application: id, version, status, parallelism, executors."""
        sc = self.spark.sparkContext
        stopped = sc._jsc.sc().isStopped()
        nodes = 0 if stopped else sc._jsc.sc().getExecutorMemoryStatus().size()
        row = [(sc.applicationId, sc.version, "DOWN" if stopped else "UP", sc.defaultParallelism, nodes)]
        return self.spark.createDataFrame(row, "id string, version string, status string, parallelism int, nodes int")

    def nodes(self) -> DataFrame:
        """(id, address, port, status, is_local, max_memory, free_memory) of the driver and each executor, lost ones as OFFLINE."""
        known, rows = self.spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator(), []
        while known.hasNext():
            e = known.next()
            address, _, port = e.hostPort().rpartition(":")
            rows.append((e.id(), address, int(port), "ONLINE" if e.isActive() else "OFFLINE", e.id() == "driver", e.maxMemory(), e.maxMemory() - e.memoryUsed()))
        return self.spark.createDataFrame(rows, "id string, address string, port int, status string, is_local boolean, max_memory long, free_memory long")

    def cluster_stats(self) -> DataFrame:
        """One row: node_count, online_nodes, offline_nodes, local_node_id."""
        online = F.count_if(F.col("status") == "ONLINE").alias("online_nodes")
        offline = F.count_if(F.col("status") == "OFFLINE").alias("offline_nodes")
        return self.nodes().agg(F.count(F.lit(1)).alias("node_count"), online, offline, F.max(F.when(F.col("is_local"), F.col("id"))).alias("local_node_id"))


def union_of(shards: list[DataFrame]) -> DataFrame:
    """All rows of all shards, columns by place; a shard that fails fails the query."""
    if not shards:
        raise InvalidQuery("no shard")
    return reduce(DataFrame.union, shards)


def per_shard_limit(shards: list[DataFrame], n: int, order: list) -> DataFrame:
    """Unsorted first n rows of each shard, then the top n of these: the reproduced system's, which is no true top n."""
    cut = [s.orderBy(*in_order()).limit(n) for s in shards]
    return union_of(cut).orderBy(*order).limit(n)


__all__ = ["Engine", "per_shard_limit", "union_of"]
