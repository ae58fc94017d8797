"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistagrid.session import checkpoint_dir

# Lower-cases A-Z and turns every byte that is not part of [0-9a-z] or a non-ASCII character into a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Text bytes that one step inside a task handles together.
CHUNK_BYTES = 2 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null reads as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def sized_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text each; a longer text makes a run of its own."""
    if not batch.num_rows:
        return
    lengths = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    group = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(int(lo), int(hi - lo))


def small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python workers in batches of at most `BATCH_ROWS`, so workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def release_memory() -> None:
    """Gives what freed arrays left in the pools back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(fn: Callable) -> Callable:
    """The same function on groups (pandas) or batches (Arrow); its memory is given back when it ends.

    An executor keeps more Python workers than it has cores, and those that wait would otherwise hold what their last task needed.
    """
    def done(*args):
        try:
            return fn(*args)
        finally:
            release_memory()

    # Spark counts the arguments of what it calls.
    if inspect.isgeneratorfunction(fn):
        @functools.wraps(fn)
        def run(batches):
            try:
                yield from fn(batches)
            finally:
                release_memory()
    elif len(inspect.signature(fn).parameters) == 1:
        @functools.wraps(fn)
        def run(group):
            return done(group)
    else:
        @functools.wraps(fn)
        def run(left, right):
            return done(left, right)
    return run


def appended(df: DataFrame, extra: str, drop: list[str] | None = None) -> tuple[DataFrame, T.StructType]:
    """Input without the columns whose names the operator writes itself, and the schema with the new columns."""
    fields = T._parse_datatype_string(extra).fields
    names = {f.name.lower() for f in fields} | {n.lower() for n in drop or []}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    return kept, T.StructType([*kept.schema.fields, *fields])


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array], schema: T.StructType) -> pa.RecordBatch:
    """Batch with further columns, in the order of the Spark schema."""
    arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | columns
    return pa.RecordBatch.from_arrays([arrays[f.name] for f in schema.fields], names=[f.name for f in schema.fields])


def reliable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there: later steps survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `reliable`, as a compressed table in the shared checkpoint folder: for rows that hold packed texts."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
