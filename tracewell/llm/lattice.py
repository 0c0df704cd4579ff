"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, neighbouring cells, verified cosine.

In each of TABLES tables a vector's direction is projected into BLOCKS blocks of eight dimensions
and each block decoded to the nearest point of the lattice E8; the points of all blocks name the
vector's cell. A vector owns its cell and visits the PROBES cells that differ from it by the
neighbouring lattice points nearest to it. Pairs of which one owns the cell that both are in are
compared by cosine in double precision, so no pair below the threshold is ever linked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .components import connected_components

TABLES, BLOCKS, PROBES, SCALE, SEED = 12, 2, 8, 1.6, 20240229
#: Members of a cell up to which it is compared at once; a fuller one is dealt into chunks of half as many.
AT_ONCE = 1024
#: Rows of whole cells that are gathered before they are compared.
ROWS = 8192


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for signs in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = signs
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    rest = (x - r)[odd]
    worst = np.abs(rest).argmax(1)
    at = np.arange(len(odd))
    r[odd, worst] += np.where(rest[at, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight numbers."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projection(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).normal(size=(dim, TABLES * BLOCKS * 8)) / SCALE


def _names(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit name of each row of doubled lattice coordinates, with its table and dimension."""
    x = np.full(len(points), (table * 1_000_003 + dim) & 0xFFFFFFFF, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        x = (x ^ column) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of one dimension: the cell each owns in each table, and the cells it visits there.

    Projections are rounded to a fixed grid, so they do not depend on how rows are batched.
    """
    n, dim = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    flat = np.rint(unit @ _projection(dim) * 2.0**24) / 2.0**24
    near, each = neighbours(), PROBES // BLOCKS
    own, visited = np.empty((n, TABLES), np.int64), np.empty((n, TABLES, each * BLOCKS), np.int64)
    for t in range(TABLES):
        x = flat[:, t * BLOCKS * 8 : (t + 1) * BLOCKS * 8]
        point = np.concatenate([decode(x[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)], axis=1)
        own[:, t] = _names(point, t, dim)
        for k in range(BLOCKS):
            side = slice(8 * k, 8 * k + 8)
            score = np.rint((x[:, side] - point[:, side]) @ near.T * 2.0**20)
            best = np.argsort(-score, axis=1, kind="stable")[:, :each]
            for i in range(each):
                other = point.copy()
                other[:, side] += near[best[:, i]]
                visited[:, t, k * each + i] = _names(other, t, dim)
    return own, visited


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows by dimension: their positions and their vectors in double precision, scaled by a power of two to components of 1 at most.

    Cosines stay as they are to the last bit, and squares neither vanish nor overflow.
    """
    sizes = np.asarray(column.value_lengths())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        own = np.asarray(flat).reshape(len(at), dim)
        yield at, np.ldexp(own, -np.frexp(np.abs(own).max(axis=1))[1][:, None])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cid, h = np.asarray(batch.column("cid")), np.asarray(batch.column("h"))
        for rows, vectors in _vectors(batch.column("v")):
            for at in range(0, len(rows), 2048):
                own, visited = cells(vectors[at : at + 2048])
                n, width = len(own), 1 + visited.shape[2]
                names = np.concatenate([own[:, :, None], visited], axis=2).reshape(-1)
                mine = np.zeros((n, TABLES, width), bool)
                mine[:, :, 0] = True
                part = np.repeat(rows[at : at + 2048], TABLES * width)
                yield pa.record_batch([pa.array(names), pa.array(mine.reshape(-1)), pa.array(cid[part]), pa.array(h[part])], ["cell", "own", "cid", "h"])


def _labels(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n nodes reaches over the links a-b."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (before == label).all():
            return label


def _compare(threshold: float):
    def group(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, cut at ``cuts``: verified links, counted where they are found first."""
        x = rows["v"]
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            ok = unit[a:b] @ unit[a:b].T >= threshold - 1e-9
            ok &= rows["own"][a:b, None] | rows["own"][None, a:b]
            ok &= np.not_equal.outer(rows["half"][a:b], rows["half"][a:b]) | (rows["single"][a])
            i, j = np.nonzero(np.triu(ok, 1))
            left.append(i + a)
            right.append(j + a)
        a, b = np.concatenate(left), np.concatenate(right)
        exact = np.einsum("ij,ij->i", x[a], x[b]) / (np.sqrt(np.einsum("ij,ij->i", x[a], x[a])) * np.sqrt(np.einsum("ij,ij->i", x[b], x[b])))
        same = (rows["cid"][a] == rows["cid"][b]) & (rows["h"][a] == rows["h"][b])
        keep = (exact >= threshold) & ~same
        a, b = a[keep], b[keep]
        if not len(a):
            return
        used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        p, q = back[: len(a)], back[len(a) :]
        own, visited = cells(x[used])
        alike = own[p] == own[q]
        to_q = (visited[p] == own[q][:, :, None]).any(2)
        to_p = (visited[q] == own[p][:, :, None]).any(2)
        table = (alike | to_q | to_p).argmax(1)
        at = np.arange(len(p))
        both = to_q[at, table] & to_p[at, table]
        smaller = (rows["cid"][a] < rows["cid"][b]) | ((rows["cid"][a] == rows["cid"][b]) & (rows["h"][a] < rows["h"][b]))
        in_p = np.where(alike[at, table] | (both & smaller), True, ~to_q[at, table])
        first = np.where(in_p, own[p, table], own[q, table]) == rows["cell"][a]
        counts = np.zeros(len(used), np.int64)
        np.add.at(counts, p[first], rows["n"][b[first]])
        np.add.at(counts, q[first], rows["n"][a[first]])
        ids = rows["cid"][used]
        label = _labels(len(used), p, q, ids)
        told = (counts > 0) | (label != ids)
        yield pa.record_batch([pa.array(ids[told]), pa.array(rows["h"][used][told]), pa.array(counts[told]), pa.array(label[told])], ["cid", "h", "more", "to"])

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        rows = {c: np.asarray(table[c]) for c in ("cell", "i", "j", "half", "own", "cid", "h", "n")}
        rows["single"] = rows["i"] == rows["j"]
        for at, vectors in _vectors(table["v"].combine_chunks()):
            own = {k: v[at] for k, v in rows.items()} | {"v": vectors}
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(own["cell"]) != 0) | (np.diff(own["i"]) != 0) | (np.diff(own["j"]) != 0)
            yield from group(own, np.append(np.flatnonzero(new), len(at)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and chunks; a group that a batch ends in waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                key = list(zip(*(np.asarray(piece.column(c)).tolist() for c in ("cell", "i", "j"))))
                end = len(key)
                while end and key[end - 1] == key[-1]:
                    end -= 1
                if end or (held and _key(held[-1]) != key[0]):
                    if held and _key(held[-1]) != key[0]:
                        yield from whole(held)
                        held = []
                    if end:
                        yield from whole([*held, piece.slice(0, end)])
                        held = []
                held.append(piece.slice(end))
        if held:
            yield from whole(held)

    return task


def _key(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(c)[-1].as_py() for c in ("cell", "i", "j"))


def embedding_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``; links
    are found with probability and none is made below it. n_links counts the other rows linked
    directly, component_id is the smallest id reachable, kept tells whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different dimensions, nor rows without an id, whose component_id and kept are
    null. Equal vectors are one class that is compared once; its rows are all linked to each other.
    Rows that share an id are one node of the component, each with its own links. Ids are longs.
    Rows meet their class by a 128-bit hash of the vector, so vectors travel once, into their classes.
    A cell of more than AT_ONCE classes is dealt into chunks of half as many, each pair of which is
    compared as one matrix: all its pairs are compared, as n_links counts each, and none is a row.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound & F.col(id_col).isNotNull(), F.lit(False)), F.col(vector_col)).alias("v"))
    every = every.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(SEED), "v"))  # 128 bits name a vector
    classes = every.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.any_value("h").alias("h"), F.any_value("g").alias("g"))
    classes = staged(classes, "vectors")
    named = staged(classes.select("cid", "h", "v").mapInArrow(_named, "cell long, own boolean, cid long, h long"), "cells")
    sizes = named.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("own").alias("owners")).where("size > 1 and owners > 0").select("cell", "size")
    members = named.join(sizes, "cell").join(classes.drop("g"), ["cid", "h"])
    chunks = F.when(F.col("size") <= AT_ONCE, F.lit(1)).otherwise(F.ceil(F.col("size") / (AT_ONCE // 2)).cast("int"))
    own_chunk = F.pmod(F.xxhash64("cid", "h"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "chunk").alias("i"), F.greatest(k, "chunk").alias("j")))
    dealt = members.withColumn("chunks", chunks).withColumn("chunk", own_chunk).withColumn("p", F.explode(pairs)).select("cell", "p.i", "p.j", F.col("chunk").alias("half"), "own", "cid", "h", "n", "v")
    keys = ["cell", "i", "j"]
    found = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "cid long, h long, more long, to long")
    found = staged(found, "found")
    components = connected_components(found.where("cid <> to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("cid", "h").agg(F.sum("more").alias("more"))
    told = classes.join(counted, ["cid", "h"], "left").join(components.withColumnRenamed("node", "cid"), "cid", "left")
    told = told.select("h", "g", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    sound_ = F.col("v").isNotNull()
    named = every.select("vec_id", F.when(sound_, F.col("h")).alias("h"), F.when(sound_, F.col("g")).alias("g"))
    out = named.join(told, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
