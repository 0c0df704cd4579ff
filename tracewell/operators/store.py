"""A store of tables that change together: snapshots by manifest, copies of touched buckets, a rename as the commit.

A table's rows lie in buckets by the hash of its keys, a folder each. A commit writes new folders for the
buckets that its rows fall into, beside the old ones, and then one manifest that names all folders of all
tables. The manifest appears by a rename that fails where its number is taken. So readers see all
of a commit or nothing of it, a commit that breaks off leaves the old state, and of two commits on one
snapshot the second fails. Rows of other buckets are neither read nor written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.relational import upsert

BUCKETS, BUCKET = 64, "__bucket"


class Conflict(RuntimeError):
    """Another commit was made since the snapshot that this one began with."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshot(spark: SparkSession, store: str) -> dict:
    """The newest manifest: its number, and of each table its keys, buckets, schema and the folder of each bucket."""
    folder = _path(spark, f"{store}/manifests")
    system = _system(spark, folder)
    numbers = [int(f.getPath().getName()[:-5]) for f in system.listStatus(folder) if f.getPath().getName()[:-5].isdigit()] if system.exists(folder) else []
    if not numbers:
        return {"number": 0, "tables": {}}
    text = "".join(r[0] for r in spark.read.text(f"{store}/manifests/{max(numbers)}.json").collect())
    return json.loads(text)


def table(spark: SparkSession, store: str, name: str, at: dict | None = None) -> DataFrame:
    """A table as the newest snapshot, or the one given, has it."""
    told = (at or snapshot(spark, store))["tables"][name]
    return _read(spark, store, told, sorted(told["folders"]))


def _read(spark: SparkSession, store: str, told: dict, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(told["schema"])
    paths = [f"{store}/{told['folders'][b]}" for b in buckets if b in told["folders"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write_manifest(spark: SparkSession, store: str, told: dict) -> None:
    """The manifest under its number, which no other has."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = _path(spark, f"{store}/manifests")
    system = _system(spark, folder)
    system.mkdirs(folder)
    draft = _path(spark, f"{store}/manifests/.draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()
    final = _path(spark, f"{store}/manifests/{told['number']}.json")
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(draft, final, none)
    except Exception as error:
        system.delete(draft, False)
        if system.exists(final):
            raise Conflict(f"snapshot {told['number']} is there already") from error
        raise


def commit(spark: SparkSession, store: str, changes: dict[str, tuple[DataFrame, list[str]]], *, replaced: dict[str, DataFrame] | None = None, at: dict | None = None, buckets: int = BUCKETS) -> dict:
    """Put rows into tables, all or none, and return the new snapshot.

    ``changes`` has (rows, keys) of each table: rows replace those of equal keys. ``replaced`` has, for
    tables keyed by their parent's key, the keys whose old rows all go, whether new ones come or not.
    ``at`` is the snapshot to build on, the newest unless given; Conflict if another commit was faster.
    A table's keys and number of buckets are those of its first commit. Rows of null keys are kept in
    a bucket of their own and never equal others.
    """
    base = at or snapshot(spark, store)
    number = base["number"] + 1
    tables = dict(base["tables"])
    for name, (rows, keys) in changes.items():
        told = tables.get(name) or {"keys": keys, "buckets": buckets, "schema": json.loads(rows.schema.json()), "folders": {}}
        count = told["buckets"]
        bucket = F.when(F.concat(*[F.col(k).cast("string") for k in keys]).isNull(), -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(count))).cast("int")
        gone = (replaced or {}).get(name)
        reached = rows.select(bucket.alias("b")) if gone is None else rows.select(bucket.alias("b")).unionByName(gone.select(bucket.alias("b")))
        touched = sorted(str(r[0]) for r in reached.distinct().collect())  # at most ``count`` rows
        old = _read(spark, store, told, touched)
        if gone is not None:
            old = old.join(gone.select(*keys).distinct(), keys, "left_anti")
        folder = f"data/{name}/{number}-{uuid.uuid4().hex}"
        whole = upsert(old, rows, keys) if gone is None else old.unionByName(rows)
        whole.select(*rows.columns, bucket.alias(BUCKET)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{store}/{folder}")
        made = _path(spark, f"{store}/{folder}")
        there = {f.getPath().getName().partition("=")[2] for f in _system(spark, made).listStatus(made) if f.isDirectory()}
        folders = {k: v for k, v in told["folders"].items() if k not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in there}
        tables[name] = told | {"folders": folders}
    told = {"number": number, "tables": tables}
    _write_manifest(spark, store, told)
    return told
