"""Tables by name: declared or read from Parquet, appended to, described and dropped."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemere.errors import InvalidDefinition, SchemaMismatch, TableExists, TableNotFound
from tablemere.functions.names import col
from tablemere.functions.types import ColumnDef, logical_type, spark_type
from tablemere.operators.aggregates import column_counts
from tablemere.sources import parquet
from tablemere.sources.rows import POSITION, first_rows, hidden, leading, placed, scan, visible


@dataclass(frozen=True)
class Table:
    """A table's declaration and its rows, with their positions and without. Loads give a new one.

    Both are lazy; queries that don't depend on the order of loading take
    ``plain``, so that their scans don't number rows.
    """

    name: str
    columns: tuple[ColumnDef, ...]
    rows: DataFrame
    plain: DataFrame
    loads: int = 0
    #: Each load as what gives its rows up to a number of them, and how many it gives; None where only ``rows`` has them.
    parts: tuple[Callable[[int], tuple[DataFrame, int]], ...] | None = ()

    def head(self, n: int) -> DataFrame:
        """Rows with positions, the first ``n`` in order of loading among them: of whole Parquet loads only the first files that hold these."""
        if n <= 0 or not self.parts:
            return self.rows
        found, left = [], n
        for load, part in enumerate(self.parts):
            if left <= 0:
                break
            rows, held = part(left)
            found.append(rows.withColumn(POSITION[0], F.lit(load)))
            left -= held
        return reduce(DataFrame.union, found)


def _typed(name: str, declared: ColumnDef, have: T.DataType) -> Column:
    """A loaded column under its declared name and type."""
    loaded, want = col(name), spark_type(declared.type)
    if logical_type(have) == declared.type:
        return loaded.alias(declared.name)
    if isinstance(have, T.TimestampNTZType) and declared.type == "LONG":  # the raw number
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), loaded).alias(declared.name)
    if isinstance(have, T.TimestampType) and declared.type == "LONG":
        return F.unix_micros(loaded).alias(declared.name)
    if isinstance(have, T.DateType) and declared.type == "INTEGER":
        return F.unix_date(loaded).alias(declared.name)
    return loaded.cast(want).alias(declared.name)


class Catalog:
    """The tables of one session; names are case-sensitive and in one flat space."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, Table] = {}
        self._lock = threading.Lock()

    def _add(self, table: Table) -> Table:
        names = [c.name for c in table.columns]
        if not table.name or not names:
            raise InvalidDefinition("a table needs a name and columns")
        if len(set(names)) < len(names) or set(names) & set(POSITION):
            raise InvalidDefinition("column names must differ from each other and from the hidden ones")
        with self._lock:
            if table.name in self._tables:
                raise TableExists(f"table {table.name!r} exists")
            self._tables[table.name] = table
        return table

    def _empty(self, columns: Iterable[ColumnDef], kinds: dict[str, T.DataType] | None = None) -> DataFrame:
        fields = [T.StructField(c.name, (kinds or {}).get(c.name, spark_type(c.type)), True) for c in columns]
        hidden_fields = [T.StructField(POSITION[0], T.IntegerType()), T.StructField(POSITION[1], T.StringType()), T.StructField(POSITION[2], T.LongType())]
        return self.spark.createDataFrame([], T.StructType(fields + hidden_fields))

    def create(self, name: str, columns: Iterable[ColumnDef | dict | tuple]) -> Table:
        """Declare an empty table."""
        declared = tuple(map(ColumnDef.of, columns))
        rows = self._empty(declared)
        return self._add(Table(name, declared, rows, hidden(rows)))

    def create_from_parquet(self, name: str, path: str, row_limit: int = -1, load: bool = True) -> Table:
        """Declare a table as a Parquet file is, and load it in the same step; a failure leaves no table."""
        if name in self._tables:
            raise TableExists(f"table {name!r} exists")
        columns = tuple(parquet.inferred(self.spark, path))
        if load:
            if row_limit > 0:
                rows = first_rows(leading(self.spark, path, row_limit)[0], row_limit)
                return self._add(Table(name, columns, rows, hidden(rows), 1, None))
            return self._add(Table(name, columns, scan(self.spark, path), self.spark.read.parquet(path), 1, (partial(leading, self.spark, path),)))
        kinds = {f.name: f.dataType for f in self.spark.read.parquet(path).schema.fields}
        rows = self._empty(columns, kinds)
        return self._add(Table(name, columns, rows, hidden(rows)))

    def create_schema_from_parquet(self, name: str, path: str) -> Table:
        return self.create_from_parquet(name, path, load=False)

    def register(self, name: str, df: DataFrame, ordered: DataFrame | None = None) -> Table:
        """A table of any DataFrame's rows, with the positions they have; ``ordered``: the same rows with positions."""
        columns = tuple(ColumnDef(f.name, logical_type(f.dataType), f.nullable) for f in df.schema.fields if f.name not in POSITION)
        return self._add(Table(name, columns, placed(df if ordered is None else ordered), hidden(df), 1, None))

    def _appended(self, name: str, more: DataFrame, plain: DataFrame | None = None, path: str | None = None) -> int:
        """Add rows, columns by place; all of them or, if a NOT NULL column would get a null, none. ``path``: the whole file they are."""
        table = self.get(name)
        names = visible(more)
        if len(names) != len(table.columns):
            raise SchemaMismatch(f"{len(names)} columns for the {len(table.columns)} of {name!r}")
        kinds = {f.name: f.dataType for f in more.schema.fields}
        typed = [_typed(n, c, kinds[n]) for n, c in zip(names, table.columns, strict=True)]
        made, bare = more.select(*typed, *POSITION), (more if plain is None else plain).select(*typed)
        strict = [c.name for c in table.columns if not c.nullable]
        counts = bare.agg(*column_counts(strict)).first()  # rows alone are in the footers
        for i, c in enumerate(strict):
            if counts[i + 1]:
                raise SchemaMismatch(f"{counts[i + 1]} nulls for column {c!r}, which has none")

        def part(n: int) -> tuple[DataFrame, int]:
            if path is None:
                return made, counts["rows"]
            rows, held = leading(self.spark, path, n)
            return rows.select(*typed, *POSITION), held

        with self._lock:
            now = self._tables[name]
            rows = made.withColumn("__load", F.lit(now.loads))
            both = (now.rows.union(rows), now.plain.union(bare)) if now.loads else (rows, bare)
            parts = None if now.parts is None else (*now.parts, part)
            self._tables[name] = replace(now, rows=both[0], plain=both[1], loads=now.loads + 1, parts=parts)
        return counts["rows"]

    def load_parquet(self, name: str, path: str, row_limit: int = -1, batch_size: int | None = None) -> int:
        """Append a Parquet file's first ``row_limit`` rows, or all; how many.

        ``batch_size`` is taken and has no effect: Spark sizes its own batches.
        """
        parquet.check_fits(self.spark, path, list(self.get(name).columns))
        if row_limit > 0:
            return self._appended(name, first_rows(leading(self.spark, path, row_limit)[0], row_limit))
        return self._appended(name, scan(self.spark, path), self.spark.read.parquet(path), path)

    def append(self, name: str, rows: list[tuple]) -> int:
        """Append rows given by value, columns in order."""
        columns = self.get(name).columns
        if any(len(r) != len(columns) for r in rows):
            raise SchemaMismatch(f"rows of {name!r} have {len(columns)} values")
        fields = [T.StructField(c.name, spark_type(c.type), True) for c in columns]
        df = self.spark.createDataFrame(rows, T.StructType(fields)).coalesce(1)
        return self._appended(name, placed(df))

    def drop(self, name: str) -> None:
        with self._lock:
            table = self._tables.pop(name, None)
        if table is None:
            raise TableNotFound(f"no table {name!r}")
        table.rows.unpersist()

    def exists(self, name: str) -> bool:
        return name in self._tables

    def get(self, name: str) -> Table:
        if name not in self._tables:
            raise TableNotFound(f"no table {name!r}")
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def rows(self, name: str) -> DataFrame:
        """The table's rows without their positions."""
        return self.get(name).plain

    def describe(self, name: str | None = None) -> DataFrame:
        """(table, position, name, type, nullable) of one table's columns or of all tables'."""
        tables = [self.get(name)] if name is not None else [self._tables[n] for n in self.names()]
        found = [(t.name, i, c.name, c.type, c.nullable) for t in tables for i, c in enumerate(t.columns)]
        return self.spark.createDataFrame(found, "table string, position int, name string, type string, nullable boolean")

    def preview(self, name: str, limit: int = 10) -> DataFrame:
        """The first rows in order of loading; none if ``limit`` is 0 or less."""
        rows = self.get(name).head(limit)
        return hidden(first_rows(rows, limit) if limit > 0 else rows.limit(0))

    def stats(self, name: str) -> DataFrame:
        """(name, type, nullable, row_count, null_count, non_null_count) of each column, in one pass."""
        table = self.get(name)
        counted = table.plain.agg(*column_counts([c.name for c in table.columns]))
        each = [
            F.struct(
                F.lit(c.name).alias("name"), F.lit(c.type).alias("type"), F.lit(c.nullable).alias("nullable"), F.col("rows").alias("row_count"),
                F.col(f"n{i}").alias("null_count"), (F.col("rows") - F.col(f"n{i}")).alias("non_null_count"),
            )
            for i, c in enumerate(table.columns)
        ]
        return counted.select(F.inline(F.array(*each)))
