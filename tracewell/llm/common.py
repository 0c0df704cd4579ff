"""Helpers shared by the training-data operators: staged tables, word splitting, keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Where neither the setting nor a checkpoint folder exists, a temporary folder is made and set if
    the master is local; on a cluster, where executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here.

    A lost executor then costs no more than the tasks that were running on it. Tables that a returned
    frame reads stay until the folder is emptied; ``released`` takes away those of finished rounds.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._tracewell_path = path
    return written


def released(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``frames``, which nothing is to read again."""
    for frame in frames:
        spark, path = frame.sparkSession, frame._tracewell_path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_workers(spark: SparkSession) -> None:
    """Have the session's Python workers take less memory, unless its settings were chosen otherwise.

    Texts go to Python a thousand rows at a time instead of ten thousand. Shortened tracebacks are
    switched off: they are a variable of UDFs' workers alone, so executors would keep one set of
    workers for UDFs and another for ``mapInArrow``. Operators change no settings; this is for the
    queries and jobs that own their session.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


#: Rows that are turned into Python objects at a time; Spark bounds an Arrow batch in bytes, not in what Python makes of it.
ROWS = 1000


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow array as Python objects, ROWS at a time."""
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows, else joined by a shuffle. It is counted for that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words as an array, without empty ones; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def hex_of(value: Column) -> Column:
    """A long as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
