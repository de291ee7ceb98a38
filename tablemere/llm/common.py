"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Text bytes that a Python worker handles at once; bounds its temporary arrays.
SLICE_BYTES = 4 << 20
#: Most rows of whole texts that Spark hands to a worker at once; bounds the buffers on either side.
BATCH_ROWS = 2000
#: Whether Spark deletes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_state: dict[str, object] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where it is unset, and Spark runs on this machine alone (tests), make one.

    Other masters without one raise an error: their executors would not see a folder of the driver's.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(shared)  # set after the context began
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablemere-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from the session's spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Executions begun within delete their shuffle files when they end; the session's own setting comes back after."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again, and its path.

    Nothing reads the shuffles behind it any more, so they go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tablemere-{uuid.uuid4().hex}/{name}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop.getParent(), True)


class Scratch:
    """Tables of one operator in the shared folder, each dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        out, self._paths[name] = stored(df, name)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self._spark, self._paths.pop(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and n+1 offsets; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``text``; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _importable(spark: SparkSession, root: Path) -> bool:
    """Whether Python workers find this package by themselves: by PYTHONPATH, by installation or, run locally, by folder."""
    if str(root) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return True
    if root.is_relative_to(sys.prefix):
        return True
    return spark.sparkContext.master.startswith("local[") and Path.cwd() == root


def prepare_workers(spark: SparkSession) -> None:
    """What operators with Python code need of a session, once for each.

    Lowers Arrow batches to BATCH_ROWS (a smaller setting stays). Where workers
    would not find this package, its sources go out with Spark, by the shared
    folder.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or _importable(spark, root):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted((root / "tablemere").rglob("*.py")):
            z.write(source, source.relative_to(root))
    uri = f"{shared_folder(spark)}/tablemere-{uuid.uuid4().hex}.zip"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def worker_state(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, built once in a worker process and kept for its next tasks, until one needs another or none."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def _forget() -> None:
    if _state:
        _state.clear()
        gc.collect()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[..., Iterator[pa.RecordBatch]], state: bool = False) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` of a task that, but with ``state``, drops what other operators' tasks left in its worker, and gives unused memory back at its end.

    Workers outlive their stages, so what they hold would count beside all later ones.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            _forget()  # by name: a worker gets a copy of this function's globals, but not of the module's
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidy


def map_texts(
    df: DataFrame, fn: Callable[..., dict[str, object]], keep: list[str], text: str, added: str, nulls: bool = False, state: bool = False
) -> DataFrame:
    """Apply ``fn(bytes, offsets)`` to slices of a text column; ``keep`` columns pass through.

    ``added`` names fn's arrays, in its order, and their types. With ``nulls``
    fn gets a third argument: whether each text is null. ``state``: fn keeps a
    ``worker_state``.
    """
    prepare_workers(df.sparkSession)
    fields = [df.schema[k] for k in keep]
    schema = StructType([StructField(f"k{i}", f.dataType, True) for i, f in enumerate(fields)] + _parse_datatype_string(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            col = part.column(len(keep))
            made = fn(*text_buffer(col), *([col.is_null().to_numpy(zero_copy_only=False)] * nulls))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, made.values())], schema.names)

    # names of the columns that pass through don't matter to the workers, whatever they are
    inner = df.select(*[F.col(_quoted(k)).alias(f"k{i}") for i, k in enumerate(keep)], F.col(_quoted(text)).cast("string").alias("t"))
    out = inner.mapInArrow(tidied(run, state), schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *schema.names[len(keep) :])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(_quoted(c)) for c in df.columns if c not in but])


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most ``rows`` rows, those with the smallest seeded hash of ``key``: a fixed, unbiased sample.

    Hashes are even, so of a large table only the part that holds about twice as
    many is sorted: the last task gets a few times ``rows`` and not that from every
    partition.
    """
    place, total = F.xxhash64(F.lit(seed), F.col(key)), df.count()
    wanted = 2 * rows + 100  # the hundred is for samples of a few rows
    if total > 2 * wanted:
        low = df.where(place < F.lit((wanted << 64) // total - (1 << 63)))
        if low.count() >= rows:  # not where a few keys have most rows
            df = low
    return df.orderBy(place, F.col(key)).limit(rows)
