"""Points in intervals of any lengths, as a join by equal keys.

An interval is the disjoint union of at most two aligned blocks a power of two, so it is some 2 log of
its length rows; a point is in one block of each power. A point and an interval meet in exactly
one block, whether intervals are short, long or both.

Where only how many points an interval has and the greatest of them are wanted, no pair is made
(``others_in``): blocks are summed up first, and an interval reads those that it is made of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of two that blocks have: enough for any two longs.
POWERS = 63


def blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (power, place) that an interval from ``lo`` to ``hi``, both in it, is made of; none if it is empty."""
    end = hi + 1

    def of(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, behind = F.call_function("shiftright", lo + size - 1, k), F.call_function("shiftright", end, k)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        left = F.when(odd(first), F.struct(k.alias("power"), first.alias("place")))
        right = F.when(odd(behind), F.struct(k.alias("power"), (behind - 1).alias("place")))
        return F.when(first < behind, F.array_compact(F.array(left, right))).otherwise(F.array().cast("array<struct<power:int,place:bigint>>"))

    # blocks are no larger than the interval
    largest = F.least(F.length(F.bin(F.greatest(end - lo, F.lit(1).cast("long")))), F.lit(POWERS - 1)).cast("int")
    return F.when(lo <= hi, F.flatten(F.transform(F.sequence(F.lit(0), largest), of)))


def points_in(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """All columns of ``points`` and ``intervals`` (no name twice but ``keys``) for each point in an interval of equal keys.

    Longs, ends included. Points are looked for in the powers that intervals have only, a row each
    of at most POWERS. Nulls meet nothing.
    """
    made = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("__b", F.explode(blocks(F.col(lo).cast("long"), F.col(hi).cast("long")))).select("*", F.col("__b.power").alias("__power"), F.col("__b.place").alias("__place")).drop("__b")
    powers = [r[0] for r in made.select("__power").distinct().collect()]  # at most POWERS rows
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("power"), F.shiftright(F.col(at).cast("long"), k).alias("place")) for k in sorted(powers)])) if powers else None
    if each is None:
        return points.limit(0).join(intervals, keys) if keys else points.limit(0).crossJoin(intervals.limit(0))
    looked = points.where(F.col(at).isNotNull()).withColumn("__p", each).select("*", F.col("__p.power").alias("__power"), F.col("__p.place").alias("__place")).drop("__p")
    return looked.join(made, [*keys, "__power", "__place"]).drop("__power", "__place")


#: Points of a bucket as it is first cut, and places of one at most, unless it is as narrow as can be.
BUCKET, CROWD = 512, 8192
#: What stands for no point in ``_best_within``.
_NONE = np.iinfo(np.int64).min


def _merged(a: tuple, b: tuple) -> tuple:
    """The greatest (value, its owner, the greatest of other owners) of two such, whether they overlap or not."""
    (am, au, ar), (bm, bu, br) = a, b
    first = am >= bm
    other = np.where(first, np.where(bu == au, br, bm), np.where(bu == au, ar, am))
    return np.where(first, am, bm), np.where(first, au, bu), np.maximum(np.where(first, ar, br), other)


def _best_within(at: np.ndarray, best: tuple, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(from, behind, best) of each interval among sorted places; ranges of a power of two are merged once and each interval reads two."""
    first, behind = np.searchsorted(at, lo, "left"), np.searchsorted(at, hi, "right")
    length = behind - first
    out = tuple(np.full(len(lo), _NONE) for _ in range(3))
    size = 1
    while len(best[0]):
        own = np.flatnonzero((length >= size) & (length < 2 * size))
        found = _merged(tuple(x[first[own]] for x in best), tuple(x[behind[own] - size] for x in best))
        for whole, x in zip(out, found):
            whole[own] = x
        best = _merged(tuple(x[:-size] for x in best), tuple(x[size:] for x in best))
        size *= 2
    return first, behind, out


def _answered(key: tuple, places: pa.Table, asked: pa.Table) -> pa.Table:
    """(id, own, c, m, u, r): what the places of one bucket say to the intervals that begin or end in it."""
    plain = lambda t, name, none=0: t.column(name).fill_null(none).to_numpy()
    at = plain(places, "at")
    order = np.argsort(at, kind="stable")
    best = tuple(plain(places, n, _NONE if n != "u" else 0)[order] for n in ("m", "u", "r"))
    first, behind, found = _best_within(at[order], best, plain(asked, "lo"), plain(asked, "hi"))
    counts = np.concatenate([[0], np.cumsum(plain(places, "c")[order])])
    columns = [pa.array(x, pa.int64(), mask=x == _NONE) if k != 1 else pa.array(x, pa.int64()) for k, x in enumerate(found)]
    return pa.table([asked.column("id"), asked.column("own"), pa.array(counts[behind] - counts[first], pa.int64()), *columns], ["id", "own", "c", "m", "u", "r"])


def _two_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, m, u, r, ru) of rows (keys, u, m, c), one for each u: all of c, the greatest m and its u, the next and its u."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("m"), "u"))
    pick = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name)))
    return rows.withColumn("k", place).groupBy(*keys).agg(F.sum("c").alias("c"), pick("m", 1).alias("m"), pick("u", 1).alias("u"), pick("m", 2).alias("r"), pick("u", 2).alias("ru"))


def _width(points: DataFrame) -> int:
    """The power of two that buckets are wide: some BUCKET points in each, narrower where places crowd."""
    n, low, high = points.agg(F.count("*"), F.min("at"), F.max("at")).first()  # one row
    if not n:
        return 0
    width = max(0, (high - low).bit_length() - (n // BUCKET).bit_length())
    while width:
        crowd = points.select(F.shiftright("at", width).alias("b"), "at").distinct().groupBy("b").count().agg(F.max("count")).first()[0]
        if crowd <= CROWD:
            break
        width = max(0, width - 3)
    return width


def others_in(points: DataFrame, at: str, owner: str, value: str, intervals: DataFrame, key: str, lo: str, hi: str, own: str) -> DataFrame:
    """(key, n, last): of each key's intervals, how many points of other owners they have and their greatest value.

    All columns are longs, ends are included; nulls and intervals without such a point give nothing. Points are
    summed up by place, places by bucket, buckets by aligned blocks of them. An interval asks the two
    buckets it ends in and the blocks between, so rows grow with points and intervals, not with their pairs.
    Each sum keeps its greatest value and that of another owner, as the greatest may be the interval's own; its own points
    are counted by a running sum over each owner's and taken off.
    """
    long = lambda *names: [F.col(a).cast("long").alias(b) for a, b in names]
    given = points.where(F.col(at).isNotNull() & F.col(owner).isNotNull()).select(*long((at, "at"), (owner, "u"), (value, "m")))
    asked = intervals.where((F.col(lo) <= F.col(hi)) & F.col(own).isNotNull()).select(*long((key, "id"), (lo, "lo"), (hi, "hi"), (own, "own")))
    width = _width(given)
    bucket = lambda c: F.shiftright(c, width)
    by_owner = given.groupBy("at", "u").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    places = _two_best(by_owner, ["at"]).select(bucket("at").alias("b"), "at", "c", "m", "u", "r")
    ends = asked.withColumn("first", bucket("lo")).withColumn("final", bucket("hi"))
    both = F.when(F.col("first") == F.col("final"), F.array("first")).otherwise(F.array("first", "final"))
    local = ends.select("id", "own", "lo", "hi", F.explode(both).alias("b"))
    shape = "id long, own long, c long, m long, u long, r long"
    edges = places.groupBy("b").cogroup(local.groupBy("b")).applyInArrow(_answered, shape)
    # what lies between two buckets is made of blocks of buckets
    inner = ends.select("id", "own", F.explode(blocks(F.col("first") + 1, F.col("final") - 1)).alias("k")).select("id", "own", "k.*")
    powers = F.explode(F.transform(F.sequence(F.lit(0), F.lit(POWERS - width)), lambda k: F.struct(k.cast("int").alias("power"), F.call_function("shiftright", F.col("b"), k).alias("place"))))
    by_bucket = _two_best(by_owner.groupBy(bucket("at").alias("b"), "u").agg(F.sum("c").alias("c"), F.max("m").alias("m")), ["b"])
    two = F.explode(F.array(F.struct("u", "m", "c"), F.struct(F.col("ru").alias("u"), F.col("r").alias("m"), F.lit(0).cast("long").alias("c")))).alias("x")
    dealt = by_bucket.select("b", two).where("x.u is not null").select(powers.alias("k"), "x.*").groupBy("k.power", "k.place", "u").agg(F.sum("c").alias("c"), F.max("m").alias("m"))
    whole = inner.join(_two_best(dealt, ["power", "place"]).drop("ru"), ["power", "place"]).select("id", "own", "c", "m", "u", "r")
    best = F.when(F.col("u") == F.col("own"), F.col("r")).otherwise(F.col("m"))
    found = edges.unionByName(whole).select("id", "c", best.alias("m"))
    # an owner's points up to an interval's end, less those before it
    steps = by_owner.select(F.col("u").alias("own"), "at", F.lit(1).alias("step"), "c", F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign"))
    marks = lambda c, step, sign: asked.select("own", F.col(c).alias("at"), F.lit(step).alias("step"), F.lit(0).cast("long").alias("c"), "id", F.lit(sign).alias("sign"))
    upto = F.sum("c").over(Window.partitionBy("own").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    mine = steps.unionByName(marks("lo", 0, 1)).unionByName(marks("hi", 2, -1)).withColumn("run", upto).where("sign <> 0")
    every = found.unionByName(mine.select("id", (F.col("sign") * F.col("run")).alias("c"), F.lit(None).cast("long").alias("m")))
    return every.groupBy("id").agg(F.sum("c").alias("n"), F.max("m").alias("last")).where("n > 0").select(F.col("id").alias(key), "n", "last")
