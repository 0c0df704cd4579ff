"""Document fingerprints by one-permutation MinHash; DataFrame functions only.

Every shingle is hashed once. The top bits of its hash choose one of BINS bins, the bin keeps its
smallest hash; an empty bin borrows from a filled one. Which one is drawn for each empty bin alike
in all documents: the filled bin with the smallest hash of (empty bin, filled bin), so two
documents borrow from the same bin as long as both have it filled (optimal densification, with the
draw made at once instead of by repeated tries). Of each bin the lowest BITS bits are kept.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions, words

BINS, BITS = 128, 8
#: Hexadecimal digits of a bin.
DIGITS = BITS // 4
#: Ranges of ids in which a document finds its successor, at least; as many as shuffle partitions if those are more.
RANGES = 256


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS - 1).bit_length())


def shingle_hashes(found: Column, shingle: int = 5) -> Column:
    """64-bit hashes of all runs of ``shingle`` words, repeats included; a shorter text is one run, none gives none.

    ``found`` is an array of words. A shingle's hash is XXH64 over its words' XXH64 hashes.
    """
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        whole = F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(F.slice(h, i, shingle)))
        return F.when(n >= shingle, whole).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, runs)


def bins(hashes: Column) -> Column:
    """The smallest hash of each filled bin, by bin; hashes ascend as signed longs, bins as unsigned."""

    def first(h: Column) -> Column:
        return F.concat(F.slice(h, 1, 1), F.filter(h, lambda x, i: _bin(x.bitwiseXOR(F.get(h, i - 1))) > 0))

    return let(F.sort_array(hashes), first)


def packed(filled: Column) -> Column:
    """BINS times BITS bits in hexadecimal, '' where no bin is filled."""
    digits = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1)))), DIGITS, "0")

    def filled_in(f: Column) -> Column:
        by = F.map_from_entries(F.transform(f, lambda x: F.struct(_bin(x), x)))

        def own(m: Column) -> Column:
            def one(b: Column) -> Column:
                borrowed = F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(b, _bin(x)), x.alias("v"))))
                return digits(F.coalesce(F.try_element_at(m, b), borrowed.getField("v")))

            return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), one), "")

        return F.when(F.size(f) == 0, F.lit("")).otherwise(let(by, own))

    return let(filled, filled_in)


def fingerprint(text: Column, shingle: int = 5) -> Column:
    """The fingerprint of a whole text; null, empty and blank texts have ''."""
    return packed(bins(shingle_hashes(words(text), shingle)))


def likeness(a: Column, b: Column) -> Column:
    """An estimate of the Jaccard likeness of two shingle sets, 0 to 1, from their fingerprints.

    Bins agree by chance once in 2**BITS; that share is taken off. Two fingerprints without
    shingles are alike, one with and one without are not.
    """
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS), 1).otherwise(0),
    )
    chance = 2.0**-BITS
    fair = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fair)))


def _key(hash_: Column) -> Column:
    """Rows in order: null ids first, then by id, equal ids by the hash of their text."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), hash_.alias("h"))


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int | None, int]]:
    """Ids that begin a range, ascending, and into how many parts an id (None: no id) is split that fills whole ranges alone."""
    ranges = max(RANGES, partitions(docs.sparkSession))
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)), F.count("*"), F.count("doc_id")).first()
    often = Counter(found[0] or [])
    parts: dict[int | None, int] = {x: n for x, n in often.items() if n > 1}
    if nulls := found[1] - found[2]:
        parts[None] = max(1, ranges * nulls // found[1])
    return sorted(often), parts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """``docs`` as (doc_id, text, next_text, ghost, part, sub) and the window that orders them.

    The next document is that with the next larger id (equal ids: by the XXH64 of the text), after
    the last the first; null ids come first. Rows are dealt by range of ids, so no task sees all of
    them; null ids and an id that fills whole ranges alone are dealt further by the hash, so only
    copies of one row share a task. The row that begins a part goes to the part before it as well, as
    a ghost at its end, and the first row of all to the last part: one ghost a part, found by its
    key. Ghosts are to be dropped once the window has been used. The driver sees a few numbers a part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts, split = _ranges(docs)
    id_, hash_ = F.col("doc_id"), F.xxhash64("text")
    step = math.isqrt(len(starts)) + 1
    inner = F.lit(starts) if starts else F.array().cast("array<bigint>")
    upto = lambda a: F.size(F.filter(a, lambda x: x <= id_))
    coarse = F.lit(starts[::step]) if starts else inner
    docs = docs.withColumn("__tw_c", F.when(id_.isNull(), 0).otherwise(upto(coarse)))
    block = (F.greatest(F.col("__tw_c"), F.lit(1)) - 1) * step
    docs = docs.withColumn("part", F.when(id_.isNull(), -1).when(F.col("__tw_c") == 0, 0).otherwise(block + upto(F.slice(inner, block + 1, step))))
    parts = F.when(id_.isNull(), split.get(None, 1))
    if heavy := {k: n for k, n in split.items() if k is not None}:
        parts = parts.otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kn in heavy.items() for x in kn]), id_), F.lit(1)))
    # a heavy id begins a range; what follows it there comes after all its parts
    top = F.shiftrightunsigned(hash_.bitwiseXOR(F.lit(-(2**63))), 33)
    sub = F.when(parts > 1, F.shiftright(top * parts, 31).cast("int")).when(id_.isNull(), 0).otherwise(len(starts) + RANGES + partitions(docs.sparkSession))
    docs = docs.select("doc_id", "text", "part", sub.alias("sub"))
    firsts = docs.groupBy("part", "sub").agg(F.min(_key(hash_)).alias("k")).select("part", "sub", "k.known", "k.id", "k.h").collect()
    firsts.sort(key=lambda r: (r.part, r.sub))
    to = [(b.known, b.id, b.h, a.part, a.sub) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(to, "known boolean, id long, h long, to_part int, to_sub int"))
    ghosts = docs.join(wanted, (id_.isNotNull() == F.col("known")) & (F.coalesce(id_, F.lit(0)) == F.col("id")) & (hash_ == F.col("h")))
    one = ghosts.groupBy(F.col("to_part").alias("part"), F.col("to_sub").alias("sub")).agg(F.min("text").alias("text"))
    ghost = one.select(F.lit(None).cast("long").alias("doc_id"), "text", "part", "sub", F.lit(1).alias("ghost"))
    dealt = docs.withColumn("ghost", F.lit(0)).unionByName(ghost)
    order = Window.partitionBy("part", "sub").orderBy("ghost", "doc_id", hash_, "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    edited_text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document, as ``with_next`` finds it; a single document is its own
    next. Null texts count as empty and have the fingerprint ''. Repeated rows stay, next to each
    other. Ids are longs; rows without one come first, ordered by a hash of their text. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    rows, order = with_next(docs, id_col, text_col)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 2))"), F.expr("substring(next_text, 1, int(length(text) div 2))"))
    prints = rows.select("doc_id", "part", "sub", "ghost", "text", n.cast("long").alias("n_chars"), edited.alias("edited_text"), fingerprint(F.col("text"), shingle).alias("fingerprint"))
    after = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("ghost = 0")
    out = after.select("doc_id", "n_chars", "edited_text", "fingerprint", "next_fingerprint", fingerprint(F.col("edited_text"), shingle).alias("edited_fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
