"""What the operators of this package share: row mapping over texts, column names, lineage cuts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds as Python strings at a time.
SLICE_BYTES = 8 << 20


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder in spark.checkpoint.dir; a session on one machine without one (tests) gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df, so that nothing before it runs again or needs to be kept."""
    shared_folder(df)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (double underscores for dots) while something runs."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, options: dict[str, str] | None = None, **values: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: smaller than a checkpoint, and read by column.

    Its shuffle files go when it is written. options are the writer's, values
    settings while it runs.
    """
    spark, path = df.sparkSession, f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **values):
        df.select("*").write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one operator that go once its result is written."""

    def __init__(self, df: DataFrame):
        self.spark, self.tables = df.sparkSession, []

    def stored(self, df: DataFrame, options: dict[str, str] | None = None, **values: str) -> DataFrame:
        self.tables.append(made := stored(df, options, **values))
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        for made in tables or list(self.tables):
            self.tables = [x for x in self.tables if x is not made]
            for file in made.inputFiles()[:1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text each; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: else a worker keeps it between batches, and for a minute after its last task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[list[Any]]]],
    fields: list[T.StructField],
    text: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns that depend on the text of the same row; no shuffle.

    make() runs once in each task and returns a function from the texts of some
    rows to one list of values for each of `fields`. Columns of df that bear
    the name of one of the fields give way to it.
    """
    new = {f.name.lower() for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new or c == text])
    kept = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = [to_arrow(f.dataType) for f in fields]
    at, keep, names = df.columns.index(text), [df.columns.index(c) for c in kept], kept + [f.name for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at, slice_bytes):
                made = work(part.column(at).to_pylist())
                columns = [part.column(i) for i in keep]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            batch = part = made = columns = None
            give_back()
        del work
        give_back()

    return df.mapInArrow(rows, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(),
        T.BooleanType(): pa.bool_(),
        T.BinaryType(): pa.binary(),
    }
    return pa.list_(to_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind]


def fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(k, v, True) for k, v in kinds.items()]


LONG, INT, DOUBLE, STRING, BOOLEAN = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
