"""Parquet footers: what Spark's own schema leaves out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablemere.errors import EngineError, SchemaMismatch, UnsupportedType
from tablemere.functions.types import PHYSICAL, ColumnDef, logical_type


@dataclass(frozen=True)
class Field:
    name: str
    physical: str | None  # None for nested fields
    repetition: str


def footer(spark: SparkSession, path: str) -> list[Field]:
    """Fields of a Parquet file, or of a folder's first one, by Hadoop's file systems: the data isn't read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        raise EngineError(f"no file {path}")
    if fs.getFileStatus(at).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "._")
        if not names:
            raise EngineError(f"no Parquet file in {path}")
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        fields = reader.getFooter().getFileMetaData().getSchema().getFields()
        return [
            Field(f.getName(), f.asPrimitiveType().getPrimitiveTypeName().name() if f.isPrimitive() else None, f.getRepetition().name())
            for f in fields
        ]
    finally:
        reader.close()


def leading_files(spark: SparkSession, path: str, rows: int) -> tuple[list[str], int]:
    """The first data files by name that hold ``rows`` rows together, or all files, and how many they hold: by their footers, read as far as needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    taken, held = [], 0
    for name in sorted(spark.read.parquet(path).inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        try:
            held += reader.getRecordCount()
        finally:
            reader.close()
        taken.append(at.toString())
        if held >= rows:
            break
    return taken, held


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, type, repetition) of each field; nested fields are refused."""
    fields = footer(spark, path)
    for f in fields:
        if f.physical is None:
            raise UnsupportedType(f"field {f.name!r} is nested")
    rows = [(i, f.name, f.physical, f.repetition) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, repetition string")


def inferred(spark: SparkSession, path: str) -> list[ColumnDef]:
    """Columns declared from a footer: Spark's types, the footer's nullability; nested fields are refused."""
    fields, out = footer(spark, path), []
    schema = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    for f in fields:
        if f.physical is None or f.repetition == "REPEATED":
            raise UnsupportedType(f"field {f.name!r} is nested")
        out.append(ColumnDef(f.name, logical_type(schema[f.name]), f.repetition == "OPTIONAL"))
    return out


def check_fits(spark: SparkSession, path: str, columns: list[ColumnDef]) -> None:
    """A file fits a table by the number and the types of its columns, in order; names don't matter.

    A type fits if Spark reads the field as it, or if it is declared from the
    field's physical type alone.
    """
    fields, schema = footer(spark, path), {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    if len(fields) != len(columns):
        raise SchemaMismatch(f"{path} has {len(fields)} columns, the table {len(columns)}")
    for f, c in zip(fields, columns, strict=True):
        if f.physical is None:
            raise UnsupportedType(f"field {f.name!r} is nested")
        if c.type not in (PHYSICAL.get(f.physical), logical_type(schema[f.name])):
            raise SchemaMismatch(f"field {f.name!r} is {f.physical}, column {c.name!r} is {c.type}")
