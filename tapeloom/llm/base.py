"""Tables, shared folders and Arrow plumbing that the operators of this folder have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import work_dir

#: Bytes of text that a worker handles at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later plans start there, also after the loss of an executor.

    ``done`` are tables that ``stored`` gave before and that nothing reads any more once this one is written: their folders go,
    and so do the shuffle files of finished steps.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    if done:
        forget(*done)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the folders of tables that nothing reads any more.

    Spark frees shuffle files when the driver's JVM has collected the plans that made them, which it is asked to do here: else they stay as
    long as the driver has memory left, through all steps of a job.
    """
    for df in tables:
        context, path = df.sparkSession.sparkContext, _FOLDERS.pop(df, None)
        if path:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Let the driver's JVM collect the plans of finished steps, so that Spark frees their shuffle files."""
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``kernel`` over slices of the rows that hold about CHUNK_BYTES of the column ``text``."""
    limit = CHUNK_BYTES

    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > limit:
                    yield from kernel(batch.slice(start, i - start))
                    start, held = i, 0
                held += n
            if start < len(sizes):
                yield from kernel(batch.slice(start))

    import pyarrow.compute  # noqa: F401  so that pa.compute is there

    return df.mapInArrow(run, schema)


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value, body):
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Rows of two or three longs that a task may hold as the small side of a join.
SMALL_ROWS = 2_000_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few longs, marked for a broadcast if its counted rows allow it; beyond that Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df
