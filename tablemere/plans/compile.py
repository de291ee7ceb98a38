"""QuerySpec to DataFrame: scan, filter, group, sort, page, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.errors import InvalidQuery, UnknownColumn
from tablemere.functions.names import col
from tablemere.functions.semantics import ANSI, Semantics
from tablemere.operators.aggregates import aggregate
from tablemere.operators.predicates import predicate
from tablemere.plans.spec import QuerySpec
from tablemere.sources.rows import POSITION, visible


def _known(df: DataFrame, names: list[str] | tuple[str, ...]) -> None:
    """Names are case-sensitive, whatever the session says."""
    own = set(visible(df))
    for n in names:
        if n not in own:
            raise UnknownColumn(f"no column {n!r}")


def filtered(df: DataFrame, spec: QuerySpec, semantics: Semantics = ANSI) -> DataFrame:
    """The rows that satisfy every condition; all columns."""
    _known(df, [c.column for c in spec.conditions])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in spec.conditions:
        df = df.where(predicate(c.column, kinds[c.column], c.op, c.value, semantics))
    return df


def _first(df: DataFrame, count: int, skip: int, order: list[Column]) -> DataFrame:
    if count <= 0 and skip <= 0:
        return df.orderBy(*order) if order else df
    df = df.orderBy(*order, *[F.col(p) for p in POSITION if p in df.columns])
    if skip > 0:
        df = df.offset(skip)
    return df.limit(count) if count > 0 else df


def compiled(df: DataFrame, spec: QuerySpec, semantics: Semantics = ANSI) -> DataFrame:
    """The lazy result of a query on a scanned table.

    Rows keep the order of loading where a limit or an offset makes it matter,
    also among equal sort keys; nulls come first in ascending order and last in
    descending. Sorted results that aren't cut leave ties to Spark.
    """
    columns = list(dict.fromkeys(spec.columns))
    if columns in ([], ["*"]):
        columns = [] if spec.groups or spec.aggregates else visible(df)
    _known(df, [*columns, *spec.groups, *(a.column for a in spec.aggregates if a.column != "*")])
    df = filtered(df, spec, semantics)
    skip, count = spec.skip, spec.count
    if spec.limit_first and (count > 0 or skip > 0):
        df, skip, count = _first(df, count, skip, []), 0, -1
    if not spec.groups and not spec.aggregates:
        _known(df, [o.column for o in spec.order])
        return _first(df, count, skip, _keys(spec)).select(*[col(c) for c in columns])
    loose = [c for c in columns if c not in spec.groups and c not in {a.column for a in spec.aggregates}]
    if loose:
        raise InvalidQuery(f"column {loose[0]!r} is neither grouped nor aggregated")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [*dict.fromkeys(spec.groups), *(a.name for a in spec.aggregates)]
    if len(set(names)) < len(names):
        raise InvalidQuery("two result columns have one name")
    made = [aggregate(a.function, a.column, kinds.get(a.column), semantics).alias(a.name) for a in spec.aggregates]
    by = [col(g) for g in dict.fromkeys(spec.groups)]
    if made:
        out = df.groupBy(*by).agg(*made)
    else:
        out = df.select(*by).distinct()
    for o in spec.order:
        if o.column not in names:
            raise UnknownColumn(f"the result has no column {o.column!r} to sort by")
    return _first(out, count, skip, _keys(spec)).select(*[col(n) for n in names])


def _keys(spec: QuerySpec) -> list[Column]:
    return [col(o.column).asc_nulls_first() if o.ascending else col(o.column).desc_nulls_last() for o in spec.order]
