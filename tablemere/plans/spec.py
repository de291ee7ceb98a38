"""The logical query, its fluent builder and its JSON form."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from tablemere.errors import InvalidQuery
from tablemere.operators.aggregates import FUNCTIONS, function_named
from tablemere.operators.predicates import OPERATORS, SYMBOLS


@dataclass(frozen=True)
class Condition:
    """column, operator (a name or a symbol) and literal; conditions are AND-ed."""

    column: str
    op: str
    value: object = None

    def __post_init__(self) -> None:
        named = SYMBOLS.get(self.op, self.op)
        if named not in OPERATORS:
            raise InvalidQuery(f"unknown operator {self.op!r}")
        object.__setattr__(self, "op", named)

    @classmethod
    def from_json(cls, spec: dict) -> Condition:
        return cls(spec["columnName"], spec["operator"], spec.get("value"))


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str
    alias: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "function", function_named(self.function))

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}({self.column})"


@dataclass(frozen=True)
class OrderBy:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class QuerySpec:
    """SELECT columns and aggregates FROM table WHERE .. GROUP BY .. ORDER BY .. LIMIT .. OFFSET.

    No columns, or just ``*``, means all; a limit of 0 or less means none.
    ``limit_first`` takes the limit before grouping instead of at the end.
    """

    table: str
    columns: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    groups: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    order: tuple[OrderBy, ...] = ()
    count: int = -1
    skip: int = 0
    limit_first: bool = False

    def select(self, *columns: str) -> QuerySpec:
        return replace(self, columns=self.columns + columns)

    def where(self, column: str, op: str, value: object = None) -> QuerySpec:
        return replace(self, conditions=(*self.conditions, Condition(column, op, value)))

    def group_by(self, *columns: str) -> QuerySpec:
        return replace(self, groups=self.groups + columns)

    def aggregate(self, function: str, column: str, alias: str | None = None) -> QuerySpec:
        return replace(self, aggregates=(*self.aggregates, Aggregate(function, column, alias)))

    def order_by_asc(self, column: str) -> QuerySpec:
        return replace(self, order=(*self.order, OrderBy(column, True)))

    def order_by_desc(self, column: str) -> QuerySpec:
        return replace(self, order=(*self.order, OrderBy(column, False)))

    def limit(self, n: int, first: bool = False) -> QuerySpec:
        return replace(self, count=n, limit_first=first)

    def offset(self, n: int) -> QuerySpec:
        return replace(self, skip=n)

    def page(self, number: int, size: int) -> QuerySpec:
        """Page ``number``, from 1, of ``size`` rows each."""
        if number < 1 or size < 1:
            raise InvalidQuery("pages and their sizes count from 1")
        return replace(self, count=size, skip=(number - 1) * size)

    @classmethod
    def from_json(cls, spec: dict) -> QuerySpec:
        """The JSON request. A direction that isn't given is descending there, as the format has it.

        ``aggregateFunctions`` maps an alias to ``FUNC(column)`` or to ``COUNT``.
        """
        if not spec.get("tableName"):
            raise InvalidQuery("a query needs a tableName")
        out = cls(
            spec["tableName"],
            columns=tuple(spec.get("columns") or ()),
            conditions=tuple(map(Condition.from_json, spec.get("conditions") or ())),
            groups=tuple(spec.get("groupByColumns") or ()),
            aggregates=tuple(_aggregate(a, call) for a, call in (spec.get("aggregateFunctions") or {}).items()),
            count=int(spec.get("limit") or -1),
        )
        if spec.get("orderBy"):
            out = replace(out, order=(OrderBy(spec["orderBy"], bool(spec.get("orderByAscending", False))),))
        return out.page(int(spec["page"]), out.count) if spec.get("page") and out.count > 0 else out


def _aggregate(alias: str, call: str) -> Aggregate:
    found = re.fullmatch(rf"\s*({'|'.join(FUNCTIONS)})\s*(?:\(\s*(\*|\w+)\s*\))?\s*", call, re.I)
    if not found or (not found[2] and found[1].upper() != "COUNT"):
        raise InvalidQuery(f"{call!r} is no aggregate")
    return Aggregate(found[1], found[2] or "*", alias)
