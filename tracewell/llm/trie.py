"""The trie of conversations' turns: distinct nodes in preorder, subtrees as intervals, sums as differences.

1. A conversation's turns become a path: 24 bytes a turn, 16 of the SHA-256 of role and text and 8
   of the text's size. Equal paths are counted; what is left are distinct sequences.
2. Sequences are sorted by path over ranges, so a sequence's rank is a number that ascends. Below a
   node lie consecutive sequences: a node is the first and the last rank that it has, found by
   grouping the prefixes of sequences by their hash, with minima and maxima that combine in tasks.
3. Nodes in order of (first, depth) are in preorder, as a node is introduced by its first sequence and that
   sequence introduces its deeper nodes next. Sums of leaves and savings run over that order, within
   ranges at first, then with the totals of the ranges before.
4. A sequence's own last node ends what it introduces. So a subtree ends at the last node of its last
   sequence, and its total is the running sum there without the sum before its top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, released, slices, staged

#: Bytes of a turn in a path, and of a node's hash.
STEP, HASH = 24, 16
#: Ids of one node that are joined into one row at a time.
IDS = 1 << 14
#: Nodes that a task holds at a time.
FLUSH = 1 << 14


def paths(turns: DataFrame, *, key: str = "conv_id", shared: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path) of rebuilt conversations: the first h turns of conversation c - c % shared, then its own from h on.

    ``h`` is the CRC-32 of c in decimals modulo ``most``. Turns go by turn (null first), then role, then
    the hash of role and text; null roles and texts are empty, rows without an id are left out. The
    conversations that share a first part, ``2 * shared - 1`` at most, are gathered with it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * HASH)
    rows = turns.where(f"{key} is not null").select(F.col(key).cast("long").alias("conv_id"), "turn", role.alias("role"), F.concat(told, F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (STEP - HASH), "0")).alias("step"))
    base = F.col("conv_id") - F.col("conv_id") % shared
    own = rows.groupBy(base.alias("base"), "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "step"))).step.alias("steps"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("steps", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    at = own.withColumn("first", F.coalesce(first, F.array().cast("array<string>"))).withColumn("h", h)
    rebuilt = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("steps", F.col("h") + 1, F.size("steps")))
    return at.select("conv_id", F.unhex(F.array_join(rebuilt, "")).alias("path"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence's node at each depth, the root at depth 0."""
    names = ["node", "parent", "depth", "size", "rank", "members", "least", "ends"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for batch in slices(batches):
        for rank, path, members, least in zip(*(batch.column(c).to_pylist() for c in ("rank", "path", "members", "least"))):
            hashed, parent, n = hashlib.sha256(), None, len(path) // STEP
            for depth in range(n + 1):
                size = 0
                if depth:
                    step = path[STEP * (depth - 1) : STEP * depth]
                    hashed.update(step)
                    size = int.from_bytes(step[HASH:], "big")
                node = hashed.digest()[:HASH]
                rows.append((node, parent, depth, size, rank, members, least, depth == n))
                parent = node
                if len(rows) >= FLUSH:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def running(nodes: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``nodes`` with ``upto_<value>``, the sum of each value over all rows up to and with this one in ``order``.

    Rows are dealt to ranges of the order, which no row is too many for; each task sums its range and
    says its total. The totals, a row a range, are added up in order and met by the ranges' numbers.
    """
    spark = nodes.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = []
            for k, name in enumerate(values):
                sums.append(np.cumsum(batch.column(name).to_numpy(zero_copy_only=False)) + carry[k])
                carry[k] = int(sums[-1][-1])
            yield pa.record_batch([*batch.columns, *(pa.array(x, pa.int64()) for x in sums), pa.array(np.full(batch.num_rows, part), pa.int32())], [*batch.schema.names, *(f"upto_{v}" for v in values), "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + "".join(f", upto_{v} long" for v in values) + ", part int"
    summed = staged(nodes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(task, schema), "running")
    totals = summed.groupBy("part").agg(*[F.max(f"upto_{v}").alias(v) for v in values])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"off_{v}") for v in values])
    met = summed.join(F.broadcast(offsets), "part")  # a row for each range
    return met.select(*nodes.columns, *[(F.col(f"upto_{v}") + F.col(f"off_{v}")).alias(f"upto_{v}") for v in values])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conv_id): the ids of a node as comma-joined decimals, IDS at a time."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first_id", "ids"])

    for batch in slices(batches):
        for now, one in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (now != node or len(ids) >= IDS):
                yield out()
                ids = []
            node = now
            ids.append(one)
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, first_id): one SHA-256 a node, fed a row at a time."""
    node, hashed = None, None
    out = lambda: pa.record_batch([pa.array([node], pa.binary()), pa.array([hashed.hexdigest()])], ["node", "ends_sha256"])
    for batch in slices(batches):
        for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if now != node:
                if hashed is not None:
                    yield out()
                node, hashed = now, hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
    if hashed is not None:
        yield out()


def ends(convs: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ids of the conversations that end at each node, ascending and comma-joined.

    Ids are dealt to ranges of (node, id) first, so a node of very many ends is joined by many tasks;
    what is left for one is to hash the joined pieces in order, which a hash needs.
    """
    count = partitions(convs.sparkSession)
    node = F.unhex(F.substring(F.sha2("path", 256), 1, 2 * HASH))
    sorted_ = convs.select(node.alias("node"), "conv_id").repartitionByRange(count, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = sorted_.mapInArrow(_joined, "node binary, first_id long, ids string")
    return pieces.repartition(count, "node").sortWithinPartitions("node", "first_id").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, key: str = "conv_id", shared: int = 5, most: int = 9) -> DataFrame:
    """One row a node of the trie of rebuilt conversations (``paths``), the textless root included.

    ``turns`` has the key, turn, role and text; other columns are not looked at. Returns conv_id (the
    smallest member), depth, parent_conv_id (of the root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and position and last_position, a node's place in preorder from 1 and that of
    its subtree's last node. saved_tokens counts bytes of texts. An empty table gives no rows, not even the root.
    A conversation's path is one row of 24 bytes a turn; nothing else grows with its length.
    """
    spark = turns.sparkSession
    count = partitions(spark)
    convs = staged(paths(turns, key=key, shared=shared, most=most), "paths")
    distinct = convs.groupBy("path").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"))
    ranked = staged(distinct.repartitionByRange(count, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()), "sequences")
    rows = ranked.mapInArrow(_prefixes, "node binary, parent binary, depth long, size long, rank long, members long, least long, ends boolean")
    nodes = rows.groupBy("node", "parent", "depth", "size").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"), F.bool_or("ends").alias("ends"),
    )
    # a sequence that shares its first and last node's rank with none and ends there has nothing below it
    valued = nodes.withColumn("leaf", (F.col("ends") & (F.col("first") == F.col("last"))).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("one", F.lit(1).cast("long"))
    summed = staged(running(valued, ["first", "depth"], ["leaf", "saved", "one"]), "nodes")
    # of the nodes that a sequence introduces, its own end is the deepest
    closing = summed.groupBy(F.col("first").alias("closed")).agg(F.max("upto_one").alias("end_one"), F.max("upto_leaf").alias("end_leaf"), F.max("upto_saved").alias("end_saved"))
    spans = summed.join(closing, F.col("last") == F.col("closed"))
    below: Column = F.col("end_saved") - F.col("upto_saved") + F.col("saved")
    told = spans.select(
        "node", "parent", "conv_id", "depth", "n_convs", (F.col("end_leaf") - F.col("upto_leaf") + F.col("leaf")).alias("n_leaves"), below.alias("saved_tokens"),
        F.col("upto_one").alias("position"), F.col("end_one").alias("last_position"),
    )
    children = summed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    heads = told.join(children, "node", "left").join(ends(convs), "node", "left").drop("parent")
    above = summed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = summed.select("node", "parent").join(above, "parent", "left").select("node", "parent_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return heads.join(parents, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "position", "last_position",
    )
