"""The eight logical types and what they are in Spark and in Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tablemere.errors import InvalidDefinition, UnsupportedType

_SPARK: dict[str, T.DataType] = {
    "INTEGER": T.IntegerType(),
    "LONG": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}
_LOGICAL = {type(t): name for name, t in _SPARK.items()} | {
    T.ByteType: "INTEGER",
    T.ShortType: "INTEGER",
    T.TimestampNTZType: "TIMESTAMP",
    T.VarcharType: "STRING",
    T.CharType: "STRING",
}
#: Parquet physical type -> logical type of a column that is declared from it.
PHYSICAL = {
    "BOOLEAN": "BOOLEAN", "INT32": "INTEGER", "INT64": "LONG", "INT96": "TIMESTAMP", "FLOAT": "FLOAT",
    "DOUBLE": "DOUBLE", "BINARY": "STRING", "FIXED_LEN_BYTE_ARRAY": "STRING",
}
NUMERIC, TEMPORAL = ("INTEGER", "LONG", "FLOAT", "DOUBLE"), ("DATE", "TIMESTAMP")


def named(name: str) -> str:
    """The logical type of this name, in any case."""
    if not isinstance(name, str) or name.upper() not in _SPARK:
        raise InvalidDefinition(f"unknown type {name!r}")
    return name.upper()


def spark_type(logical: str) -> T.DataType:
    return _SPARK[logical]


def logical_type(spark: T.DataType) -> str:
    """The logical type that a Spark type is; nested and other types have none."""
    found = _LOGICAL.get(type(spark))
    if found is None:
        raise UnsupportedType(f"{spark.simpleString()} is none of the logical types")
    return found


@dataclass(frozen=True)
class ColumnDef:
    """A column's name, logical type and nullability; undeclared nullability is NOT NULL."""

    name: str
    type: str
    nullable: bool = False

    @classmethod
    def of(cls, declared: ColumnDef | dict | tuple) -> ColumnDef:
        if isinstance(declared, ColumnDef):
            return cls(declared.name, named(declared.type), declared.nullable)
        if isinstance(declared, dict):
            return cls(declared["name"], named(declared["type"]), bool(declared.get("nullable", False)))
        return cls(declared[0], named(declared[1]), bool(declared[2]) if len(declared) > 2 else False)
