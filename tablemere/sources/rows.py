"""Rows with the position they were loaded at, hidden behind the visible columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemere.sources.parquet import leading_files

#: Load number, file and row within the file: the order in which rows were added.
POSITION = ("__load", "__file", "__row")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in POSITION]


def in_order() -> list[Column]:
    return [F.col(p) for p in POSITION]


def scan(spark: SparkSession, *paths: str, load: int = 0, base: str | None = None) -> DataFrame:
    """Parquet files or folders with their rows' positions; only what a query uses of them is read.

    ``base`` is the folder that the paths are files of, for columns in folders' names.
    """
    reader = spark.read.option("basePath", base) if base and _is_folder(spark, base) else spark.read
    return reader.parquet(*paths).select(
        "*", F.lit(load).alias("__load"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )


def leading(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, int]:
    """A scan of the first files only that hold ``n`` rows of a Parquet file or folder, and the rows these files hold."""
    files, held = leading_files(spark, path, n)
    return scan(spark, *files, base=path), held


def placed(df: DataFrame, load: int = 0) -> DataFrame:
    """Any DataFrame with positions, those it has by itself if it has them."""
    if set(POSITION) <= set(df.columns):
        return df.withColumn("__load", F.lit(load))
    return df.select("*", F.lit(load).alias("__load"), F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in order of loading; all if n is 0 or less."""
    return df.orderBy(*in_order()).limit(n) if n > 0 else df


def hidden(df: DataFrame) -> DataFrame:
    return df.drop(*POSITION)
