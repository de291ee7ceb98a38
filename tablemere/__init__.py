"""Single-table analytics over Parquet, declared as DataFrames and left to Catalyst."""

from tablemere.engine import Engine
from tablemere.functions.semantics import ANSI, REFERENCE, Semantics
from tablemere.plans.spec import Aggregate, Condition, OrderBy, QuerySpec

__all__ = ["ANSI", "REFERENCE", "Aggregate", "Condition", "Engine", "OrderBy", "QuerySpec", "Semantics"]
