"""SimHash near-duplicate detection: pigeonhole blocks, then verified Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged, values
from .components import connected_components

#: Hashes that are turned into bits at a time, so a text of any length needs bounded memory.
STEP = 1 << 16
#: Members up to which a block's bucket is compared pair by pair.
PAIRWISE = 64
#: Rows (24 bytes each) up to which the verdicts on documents are broadcast.
BROADCAST_ROWS = 500_000


def simhash64(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, unsigned: bit i is set if over half the shingle hashes have it.

    A to Z are lower-cased, words are what white space of ASCII separates, shingles are ``shingle``
    consecutive words with repeats; a shorter text is one shingle, a text without words gives 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start, n = end - size, max(1, len(found) - shingle + 1)
    end = end[-n:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        spans = zip(start[at : min(n, at + STEP)].tolist(), end[at : at + STEP].tolist())
        hashes = np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def wide_simhash(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A SimHash of any number of bits over 64-bit shingle hashes, as 0 and 1: a bit is 1 if set in over half of what the hashes mix to.

    Bit by bit it is as ``simhash64``; of each hash SplitMix64 makes as many words of 64 bits as it takes.
    """
    steps = np.arange(-(-bits // 64), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * len(steps), np.int64)
    at_once = max(1, min(1 << 10, (1 << 14) // len(steps)))
    for at in range(0, len(hashes), at_once):
        x = hashes[at : at + at_once, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.uint16)
    return (2 * ones > len(hashes)).view(np.uint8)[:bits]


def simhash_column(text, shingle: int = 3):
    """``simhash64`` over a text column, as a signed long; null texts count as empty."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash64(x, shingle) for x in values(texts)], np.uint64).view(np.int64))

    return fingerprints(text)


def _masks(max_bits: int) -> list[int]:
    """Of max_bits + 2 blocks at least two stay whole; a mask for each choice of two."""
    count = max_bits + 2
    cut = [64 * i // count for i in range(count + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(count)]
    return [a | b for a, b in combinations(block, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``max_bits`` (0 to 2) bits apart.

    ``prints`` has one long column ``fp`` of distinct fingerprints. Every pair so close shares two
    whole blocks, so it meets in a bucket of (choice of blocks, their bits). Buckets of up to
    PAIRWISE members are joined with themselves. A fuller bucket links its members through points
    instead: each member stands at itself and at its one-bit neighbours outside the shared blocks,
    and the at most 33 members at one point are linked to their smallest. Two members are at most
    two bits apart exactly if they share a point, so the links connect the same members, in rows
    proportional to the bucket's size rather than to its square.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    masks = _masks(max_bits)
    choice = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keys = prints.select("fp", F.explode(choice).alias("k")).select("fp", "k.c", "k.key")
    sizes = keys.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(keys.join(sizes, ["c", "key"]), "blocks")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    few = members.where(F.col("n") <= PAIRWISE)
    left = few.select("c", "key", F.col("fp").alias("a"))
    right = few.select("c", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["c", "key"]).where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    points = members.where(F.col("n") > PAIRWISE).select("c", "key", "fp", F.explode(F.element_at(flips, F.col("c") + 1)).alias("flip"))
    at = points.groupBy("c", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    if max_bits < 2:  # two members at a point may be two bits apart, the point itself is one bit from each
        stars = at.where(F.array_contains("all", F.col("point"))).select(F.col("point").alias("x"), F.explode("all").alias("y"))
        stars = stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    else:
        stars = at.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    stars = stars.where((F.col("a") < F.col("b")) & near("a", "b"))
    return pairs.unionByName(stars).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp) as written, and for each distinct fp its smallest id and its component's label."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), simhash_column(F.col(text_col), shingle).alias("fp")), "simhash")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = connected_components(fingerprint_links(prints.select("fp"), max_bits))
    return rows, prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of ``docs``.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is the
    smallest id reachable by links, the row's own included. Null and blank texts have fingerprint 0
    and link like any other. Repeated rows stay and share a component. A null id never names a
    component unless the whole component has none. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    rows, labelled = _labelled(docs, id_col, text_col, shingle, max_bits)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    names = labelled.join(least, "component").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: that with the smallest id.

    A null id counts as larger than any other. Rows of a group that share its smallest id are told
    apart by fingerprint, and of rows equal in both one stays (any of them: other columns may differ).
    Null, empty and blank texts have fingerprint 0 and are duplicates of each other. An empty table
    gives no rows. The columns are those of ``docs``, in their order, whatever their names.
    """
    rows, labelled = _labelled(docs, id_col, text_col, shingle, max_bits)
    each = rows.join(labelled.select("fp", "component"), "fp")
    return keep_one(docs, each, id_col, simhash_column(F.col(text_col), shingle))


def keep_one(docs: DataFrame, each: DataFrame, id_col: str, print_: Column) -> DataFrame:
    """The rows of ``docs`` that ``simhash_keep`` keeps, given (doc_id, fp, component) of each and fp as a column of ``docs``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    keeper = each.groupBy("component").agg(F.min(order).alias("k")).select("component", "k.doc_id", "k.fp")
    copies = each.groupBy("doc_id", "fp", "component").agg(F.count("*").alias("n"))
    same = (F.col("c.component") == F.col("k.component")) & F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.fp") == F.col("k.fp"))
    verdict = copies.alias("c").join(keeper.alias("k"), same, "left").select(F.col("c.doc_id").alias("__tw_id"), F.col("c.fp").alias("__tw_fp"), F.col("k.fp").isNull().alias("__tw_gone"), "n")
    noted = staged(verdict.where("__tw_gone or n > 1").select("__tw_id", "__tw_fp", "__tw_gone"), "verdicts")
    repeated = not noted.where("not __tw_gone").isEmpty()
    printed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__tw_row"), F.col(id_col).alias("__tw_doc"), print_.alias("__tw_print"))
    told = printed.join(small(noted, BROADCAST_ROWS), F.col("__tw_doc").eqNullSafe(F.col("__tw_id")) & (F.col("__tw_print") == F.col("__tw_fp")), "left")
    alone = told.where("__tw_gone is null")
    if not repeated:
        return alone.select("__tw_row.*")
    one = told.where("not __tw_gone").dropDuplicates(["__tw_doc", "__tw_print"])
    return alone.unionByName(one).select("__tw_row.*")
