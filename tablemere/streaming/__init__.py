"""Queries over streams: the conditions and the projection of a QuerySpec on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemere.errors import InvalidQuery
from tablemere.functions.names import quoted
from tablemere.functions.semantics import ANSI, Semantics
from tablemere.plans.compile import filtered
from tablemere.plans.spec import QuerySpec


def on_stream(stream: DataFrame, spec: QuerySpec, semantics: Semantics = ANSI) -> DataFrame:
    """A stream's rows that satisfy a query's conditions, projected.

    Sorting and limits need all rows, and groups need a window: a QuerySpec with
    them is refused.
    """
    if spec.order or spec.count > 0 or spec.skip > 0 or spec.groups or spec.aggregates:
        raise InvalidQuery("streams take conditions and columns only")
    columns = stream.columns if spec.columns in ((), ("*",)) else list(dict.fromkeys(spec.columns))
    return filtered(stream, spec, semantics).select(*[F.col(quoted(c)) for c in columns])
