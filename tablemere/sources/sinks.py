"""Results as CSV, JSON and text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.functions.names import col


def _cell(name: str) -> Column:
    """A cell as CSV text: quoted only where commas, quotes or line ends need it; null is empty."""
    text = col(name).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): each row as a line of CSV, without header; keeps the order of ``df``."""
    return df.select(F.concat_ws(",", *[_cell(c) for c in df.columns]).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each row as a JSON object with all columns in order, nulls included; NaN and infinities are null."""
    finite = [
        F.when(F.isnan(col(c)) | col(c).isin(float("inf"), float("-inf")), None).otherwise(col(c)).alias(c)
        if kind in ("double", "float") else col(c).alias(c) for c, kind in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("line"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of CSV files with headers, written in parallel, or by one task if one file is asked for."""
    out = df.coalesce(1) if single_file else df
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of JSON-lines files."""
    out = df.coalesce(1) if single_file else df
    json_lines(out).write.text(path)


def csv_text(df: DataFrame) -> Iterator[str]:
    """Header and lines one by one, a partition at a time on the driver."""
    head = df.sparkSession.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))])
    yield csv_lines(head).first()["line"] + "\n"
    for row in csv_lines(df).toLocalIterator():
        yield row["line"] + "\n"


def json_text(df: DataFrame) -> Iterator[str]:
    """A JSON array, an object to a line, a partition at a time on the driver."""
    first = True
    for row in json_lines(df).toLocalIterator():
        yield ("[\n  " if first else ",\n  ") + row["line"]
        first = False
    yield "[]" if first else "\n]"


def envelope_text(df: DataFrame) -> Iterator[str]:
    """A JSON object with the columns' names, the rows and, last, their number, a partition at a time on the driver."""
    n = 0
    yield f'{{"columns": {json.dumps(df.columns, ensure_ascii=False)}, "rows": ['
    for row in json_lines(df).toLocalIterator():
        yield (", " if n else "") + row["line"]
        n += 1
    yield f'], "rowCount": {n}}}'


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a padded table, NULL for nulls."""
    cells = [[("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for v in r] for r in df.take(rows)]
    if not cells:
        return "(empty result)"
    widths = [max(len(x) for x in column) + 2 for column in zip(df.columns, *cells, strict=True)]
    line = lambda values: "".join(v.ljust(w) for v, w in zip(values, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-" * sum(widths), *map(line, cells)])
