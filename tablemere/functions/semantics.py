"""Where value semantics differ between Spark and the system whose queries are reproduced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantics:
    """Each flag turns one of the reproduced system's rules on; all off is ANSI SQL as Spark has it."""

    lenient_predicates: bool = False  # a literal or operator that doesn't fit a column makes the condition false
    regex_like: bool = False  # LIKE is a regular expression: % is .*, all else is live
    underscore_like: bool = True  # and _ is . in it
    ieee_nan: bool = False  # NaN is neither greater nor equal; it makes a minimum or maximum NaN
    count_nulls: bool = False  # COUNT(c) counts rows; AVG divides by rows
    zero_for_null: bool = False  # SUM, MIN and MAX of nulls only are 0 or ''
    keep_sum_type: bool = False  # SUM has its input's type and wraps around
    null_when_empty: bool = False  # every aggregate over no rows is null, COUNT too


ANSI = Semantics()
REFERENCE = Semantics(True, True, True, True, True, True, True, True)
