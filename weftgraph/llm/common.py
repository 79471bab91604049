"""What the corpus operators share: text access, the held-out rule, bounded samples.

Conventions that hold for every operator of this subpackage unless it says otherwise:
each input row is a document of its own, so repeated rows give repeated result rows; a
null text counts as an empty one; a null id stays null in the result; only the named id
and text columns are read, so further columns may have any name; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator turns into objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that are read, as doc_id long and text string."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of df has it, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names have."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


_loaded = 0


def settle() -> None:
    """Takes what this worker has loaded out of the garbage collector's sight, again only when
    it has loaded more: modules stay as long as the worker does, and both PySpark and
    give_back() collect after every task, which would walk all of their objects each time."""
    global _loaded
    if len(sys.modules) != _loaded:
        gc.collect()
        gc.freeze()
        _loaded = len(sys.modules)


def give_back() -> None:
    """Hands free memory of this worker back to the system; workers outlive their tasks,
    and what one stage has freed is otherwise held beside what the next one needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back when the task ends."""

    @wraps(run)
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        try:
            yield from run(batches)
        finally:
            give_back()

    return f


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, at_once: int = SLICE) -> DataFrame:
    """Runs a batch function over small slices; ``make`` is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                yield f(batch.slice(at, at_once))

    return df.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, cap: int, salt: int = 0) -> DataFrame:
    """The ``cap`` rows whose salted id hash is smallest: the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(salt)), F.col(id_col)).limit(cap)


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Inside, jobs that begin hand Python at most so many rows and bytes at a time."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
