"""Resumable collection: files that arrive are processed once, upserted by key, and never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.relational import insert_new

#: Partitions of a target by the hash of its keys.
BUCKETS, BUCKET = 64, "key_bucket"


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def collect_available(spark: SparkSession, source: str, target: str, checkpoint: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, *, schema=None, buckets: int = BUCKETS) -> DataFrame:
    """Append the new keys of all files below ``source`` that no earlier run has seen, and return ``target``.

    The target is partitioned by a hash of the keys: a batch reads the keys of those partitions that
    its own rows fall into, and no other column. A batch that was interrupted runs again and finds
    its keys already there, so nothing is doubled.
    """
    schema = schema or spark.read.parquet(source).schema

    def batch(df: DataFrame, number: int) -> None:
        rows = prepare(df).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if _there(spark, target):
            present = [r[0] for r in rows.select(BUCKET).distinct().collect()]
            known = rows.limit(0).select(*keys, BUCKET).schema
            rows = insert_new(spark.read.schema(known).parquet(target).where(F.col(BUCKET).isin(present)), rows, keys)
        else:
            rows = rows.dropDuplicates(keys)
        rows.withColumn("batch", F.lit(number)).write.partitionBy(BUCKET).mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop(BUCKET)
