"""Sharding by a pseudorandom permutation of global row numbers; DataFrame functions only.

Every row gets a global row number; a Feistel network over Z_a x Z_b, a*b at least the number of
rows, with cycle walking permutes the numbers; a row's position modulo the number of shards is its
shard, and divided by it its slot. Position, shard and slot follow from row number, number of rows
and seed alone (``position``), and back (``row_number``), without looking at the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets in which rows are numbered, at least, and rows in a bucket on average, at most; the table of bucket sizes is what gets broadcast.
BUCKETS, BUCKET_ROWS = 4096, 1 << 20
ROUNDS = 6
#: The round function works modulo this prime, so products stay below 2**62.
PRIME = 2147483647
#: Odd multipliers of the round function and of the bucket of an id.
FACTORS = (1103515245, 1566083941, 1812433253)


def _keys(seed: int) -> list[int]:
    keys, x = [], seed % PRIME
    for i in range(ROUNDS):
        x = (x * FACTORS[2] + 12345 + i) % PRIME
        keys.append(x)
    return keys


def _stir(x, key):
    """The round function, alike for Python numbers and for columns of longs."""
    low = lambda v, bits: F.shiftright(v, bits) if isinstance(v, Column) else v >> bits
    xor = lambda a, b: a.bitwiseXOR(b) if isinstance(a, Column) else a ^ b
    x = (x * FACTORS[0] + key) % PRIME
    x = (xor(x, low(x, 15)) * FACTORS[1] + key) % PRIME
    return xor(x, low(x, 13))


def domain(rows: int) -> tuple[int, int]:
    """The sides a and b of the smallest near-square domain that holds ``rows`` numbers."""
    a = max(1, math.isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def _forward(x: int, a: int, b: int, keys: list[int]) -> int:
    left, right = x // b, x % b
    for i, key in enumerate(keys):
        if i % 2:
            right = (right + _stir(left, key)) % b
        else:
            left = (left + _stir(right, key)) % a
    return left * b + right


def _backward(x: int, a: int, b: int, keys: list[int]) -> int:
    left, right = x // b, x % b
    for i in reversed(range(len(keys))):
        if i % 2:
            right = (right - _stir(left, keys[i])) % b
        else:
            left = (left - _stir(right, keys[i])) % a
    return left * b + right


def position(row: int, rows: int, seed: int = 0) -> int:
    """Where row number ``row`` of ``rows`` goes."""
    (a, b), keys = domain(rows), _keys(seed)
    x = _forward(row, a, b, keys)
    while x >= rows:
        x = _forward(x, a, b, keys)
    return x


def row_number(at: int, rows: int, seed: int = 0) -> int:
    """The row number that goes to position ``at``: the inverse of ``position``."""
    (a, b), keys = domain(rows), _keys(seed)
    x = _backward(at, a, b, keys)
    while x >= rows:
        x = _backward(x, a, b, keys)
    return x


def walk_length(rows: int, seed: int = 0) -> int:
    """Applications of the network that bring any row number back below ``rows``.

    Only the a*b - rows numbers beyond the end, fewer than 2*sqrt(rows) + 1, can be walked through.
    """
    (a, b), keys = domain(rows), _keys(seed)
    longest = 1
    for x in range(rows, a * b):
        y, steps = _forward(x, a, b, keys), 2
        while y >= rows and y != x:
            y, steps = _forward(y, a, b, keys), steps + 1
        if y < rows:
            longest = max(longest, steps)
    return longest


def permuted(df: DataFrame, row: str, to: str, rows: int, seed: int) -> DataFrame:
    """``df`` with the position of each row number; the walk is unrolled as often as it can be needed.

    The network's halves are carried as columns from round to round, not inlined into each other,
    so the expression grows with the rounds and not as a power of two.
    """
    (a, b), keys = domain(rows), _keys(seed)
    at, names = "__tw_x", df.columns
    out = df.withColumn(at, F.col(row))
    for step in range(walk_length(rows, seed)):
        out = out.withColumn("__tw_l", F.expr(f"{at} div {b}")).withColumn("__tw_r", F.col(at) % b)
        for i, key in enumerate(keys):
            if i % 2:
                out = out.withColumn("__tw_r", (F.col("__tw_r") + _stir(F.col("__tw_l"), key)) % b)
            else:
                out = out.withColumn("__tw_l", (F.col("__tw_l") + _stir(F.col("__tw_r"), key)) % a)
        moved = F.col("__tw_l") * b + F.col("__tw_r")
        out = out.withColumn(at, moved if not step else F.when(F.col(at) < rows, F.col(at)).otherwise(moved))
    return out.select(*[f"`{c}`" for c in names], F.col(at).alias(to))


def buckets_for(rows: int) -> int:
    """BUCKETS, doubled until a bucket has BUCKET_ROWS rows or fewer on average."""
    count = BUCKETS
    while count * BUCKET_ROWS < rows:
        count *= 2
    return count


def bucket_of(ids: Column, others: list[Column], buckets: int) -> Column:
    """A bucket below ``buckets`` for each id; a row without an id goes by a hash of its other columns."""
    folded = F.pmod(F.coalesce(ids.cast("long"), F.xxhash64(*others) if others else F.lit(0)), F.lit(PRIME))
    return F.shiftright((folded * FACTORS[0] + F.lit(12345)) % PRIME, 8) % buckets


def shard(df: DataFrame, shards: int, order: list[str], *, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``row`` (a struct of all columns), row_number, position, shard and slot of each row of ``df``.

    Rows are numbered by hash bucket of the id and within a bucket by id and ``order``; numbers are
    0 to the number of rows less one. The law is `rows`: shard sizes differ by at most one and slots
    run from 0 without gaps. Repeated rows get numbers of their own (which of them gets which does
    not matter, as they are alike); rows with a null id are spread by a hash of ``order``, so that
    they share no bucket. Columns may have any names, as they stay inside ``row``. An empty table
    gives no rows.

    One shuffle by bucket carries the rows; the sizes of the buckets, read from the ids alone (and
    ``order`` where an id is null), are summed up in one small window and broadcast: 16 bytes for
    each of the ``buckets_for`` the rows, one in a million of them.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = df.count()
    buckets = buckets_for(rows)
    row = F.struct(*[f"`{c}`" for c in df.columns])
    sizes = df.groupBy(bucket_of(F.col(id_col), [F.col(f"`{c}`") for c in order], buckets).alias("__tw_b")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__tw_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__tw_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__tw_before"))
    keys = [F.col(f"row.`{c}`") for c in [id_col, *order]]
    within = Window.partitionBy("__tw_b").orderBy(*keys)
    numbered = df.select(row.alias("row"), bucket_of(F.col(id_col), [F.col(f"`{c}`") for c in order], buckets).alias("__tw_b")).withColumn("__tw_n", F.row_number().over(within))
    placed = numbered.join(F.broadcast(offsets), "__tw_b").select("row", (F.col("__tw_before") + F.col("__tw_n") - 1).alias("row_number"))
    out = permuted(placed, "row_number", "position", max(1, rows), seed)
    return out.select("row", "row_number", "position", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))
