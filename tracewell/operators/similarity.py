"""Most similar texts by multiset Jaccard likeness, without meeting every pair that shares a word.

Tokens of a query are looked up rarest first. A text with an overlap of at least o of a query's n
tokens has one of any n - o + 1 of them, and the longer a text is, the larger o is for a likeness. So
a query's frequent tokens are looked up in short texts only: texts are dealt by token and by their
length's power of two, and texts too long or too short are not met at all. What the tokens looked
up leave possible bounds a pair from above, and only pairs whose bound is high enough are counted in full. For the k best the likeness asked for is that of the k-th of a few promising texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rare tokens of a query that promising texts are taken from, and texts that one of them gives at most.
SEED_TOKENS, SEED_TEXTS = 8, 256


def sizes(bags: DataFrame, key: str, name: str) -> DataFrame:
    return bags.groupBy(key).agg(F.sum("n").alias(name))


def _whole(bags: DataFrame, key: str) -> DataFrame:
    """Bags without nulls: joins would ask for that themselves, sums would not, and the bags would be made for each."""
    return bags.where(F.col(key).isNotNull() & F.col("token").isNotNull())


def looked_up(queries: DataFrame, q: str, texts: DataFrame) -> DataFrame:
    """(q, token, n, size, df, before) of the bags (q, token, n): a query's tokens with how many come before, rarest first."""
    # counted by n, so the bags are the same exchange here and elsewhere and are made once
    df = texts.groupBy("token").agg(F.sum((F.col("n") > 0).cast("long")).alias("df"))
    order = Window.partitionBy(q).orderBy("df", "token")
    told = queries.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("size", F.sum("n").over(Window.partitionBy(q))).withColumn("before", before).select(q, "token", "n", "size", "df", "before")


def _enough(overlap: Column, total: Column, num: Column, den: Column) -> Column:
    """Whether overlap / total is num / den or more, in whole numbers."""
    return overlap * den >= num * total


def _power(length: Column) -> Column:
    """The power of two below a length."""
    return F.length(F.bin(F.greatest(length, F.lit(1)).cast("long")))


def _needed(size: Column, length: Column, num: Column, den: Column) -> Column:
    """The overlap from which bags of such sizes have the likeness num / den."""
    return F.greatest(F.ceil(num * (size + length) / (num + den)).cast("long"), F.lit(1))


def candidates(tokens: DataFrame, q: str, texts: DataFrame, t: str, text_sizes: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, t, overlap, size, length, upto): pairs that may have the likeness num / den of ``asked`` (q, num, den), 0 for any.

    ``overlap`` is of the tokens looked up, those with fewer than ``upto`` before them.
    """
    size, num, den = F.col("size"), F.col("num"), F.col("den")
    longest = F.when(num > 0, F.floor((size - F.col("before")) * (num + den) / num).cast("long") - size).otherwise(F.lit(1 << 40))
    shortest = F.ceil(size * num / den).cast("long")
    own = tokens.join(asked, q).where((longest >= shortest) & (longest > 0) & (F.col("df") > 0))
    # a text's longest is long enough that a rounded quotient never takes one away
    own = own.withColumn("power", F.explode(F.sequence(_power(shortest), _power(longest + 1))))
    long = texts.join(text_sizes, t).select(t, "token", F.col("n").alias("nt"), "length", _power(F.col("length")).alias("power"))
    upto = size - _needed(size, F.col("length"), num, den) + 1
    met = own.select(q, "token", "power", F.col("n").alias("nq"), "size", "before", "num", "den").join(long, ["token", "power"]).withColumn("upto", upto)
    near = met.where((F.col("before") < F.col("upto")) & _enough(F.least("size", "length"), F.greatest("size", "length"), num, den))
    pairs = near.groupBy(q, t, "size", "length", "upto", "num", "den").agg(F.sum(F.least("nq", "nt")).alias("overlap"))
    most = F.least(F.col("overlap") + size - F.col("upto"), "size", "length")
    return pairs.where(_enough(most, size + F.col("length") - most, num, den))


def counted(pairs: DataFrame, tokens: DataFrame, q: str, texts: DataFrame, t: str) -> DataFrame:
    """(q, t, overlap, total) of ``candidates``: the overlap of the tokens not looked up added."""
    last = tokens.select(q, "token", F.col("n").alias("nq"), "before")
    more = pairs.select(q, t, "upto").join(last, q).where(F.col("before") >= F.col("upto")).join(texts.select(t, "token", F.col("n").alias("nt")), [t, "token"])
    added = more.groupBy(q, t).agg(F.sum(F.least("nq", "nt")).alias("more"))
    full = pairs.join(added, [q, t], "left").withColumn("overlap", F.col("overlap") + F.coalesce("more", F.lit(0)))
    return full.select(q, t, "overlap", (F.col("size") + F.col("length") - F.col("overlap")).alias("total"))


def at_least(queries: DataFrame, q: str, texts: DataFrame, t: str, num: int, den: int) -> DataFrame:
    """(q, t, overlap, total) of all pairs of bags whose likeness is num / den or more."""
    texts = _whole(texts, t)
    tokens = looked_up(queries, q, texts)
    asked = queries.select(q).distinct().withColumn("num", F.lit(num).cast("long")).withColumn("den", F.lit(den).cast("long"))
    found = counted(candidates(tokens, q, texts, t, sizes(texts, t, "length"), asked), tokens, q, texts, t)
    return found.where(_enough(F.col("overlap"), F.col("total"), F.lit(num), F.lit(den)))


def promised(tokens: DataFrame, q: str, texts: DataFrame, t: str, text_sizes: DataFrame, k: int) -> DataFrame:
    """(q, num, den): a likeness that k texts have at least, 0 where none is known.

    Texts of a query's rarest tokens, of a frequent one every so many, are ranked by what those tokens
    give; the 2 k best are counted in full.
    """
    rare = tokens.where("df > 0").withColumn("r", F.row_number().over(Window.partitionBy(q).orderBy("before"))).where(F.col("r") <= SEED_TOKENS)
    some = F.pmod(F.xxhash64(F.col(t), F.col("token")), F.ceil(F.col("df") / SEED_TEXTS)) == 0
    met = rare.select(q, "token", F.col("n").alias("nq"), "size", "df").join(texts.select(t, "token", F.col("n").alias("nt")), "token").where(some)
    few = met.groupBy(q, t, "size").agg(F.sum(F.least("nq", "nt")).alias("overlap")).join(text_sizes, t)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy(q).orderBy(F.desc(F.col("overlap") / (F.col("size") + F.col("length") - F.col("overlap"))), F.col(t)))).where(F.col("r") <= 2 * k)
    # all their tokens count as not looked up yet
    whole = counted(ranked.select(q, t, "size", "length", F.lit(0).cast("long").alias("overlap"), F.lit(0).cast("long").alias("upto")), tokens, q, texts, t)
    best = whole.withColumn("r", F.row_number().over(Window.partitionBy(q).orderBy(F.desc(F.col("overlap") / F.col("total")), F.col(t)))).where(F.col("r") == k)
    every = tokens.select(q).distinct().join(best.select(q, F.col("overlap").alias("num"), F.col("total").alias("den")), q, "left")
    return every.select(q, F.coalesce("num", F.lit(0)).alias("num"), F.coalesce("den", F.lit(1)).alias("den"))


def top_k(queries: DataFrame, q: str, texts: DataFrame, t: str, k: int, *, pairs: list[DataFrame] | None = None) -> DataFrame:
    """(q, t, overlap, total, rn): for each query the k texts most like it that share a token, ties by the smaller t.

    Bags are (key, token, n). ``pairs`` receives the frame of the pairs that were met, for counting.
    """
    texts = _whole(texts, t)
    tokens, text_sizes = looked_up(queries, q, texts), sizes(texts, t, "length")
    met = candidates(tokens, q, texts, t, text_sizes, promised(tokens, q, texts, t, text_sizes, k))
    if pairs is not None:
        pairs.append(met)
    full = counted(met, tokens, q, texts, t)
    place = F.row_number().over(Window.partitionBy(q).orderBy(F.desc(F.col("overlap") / F.col("total")), F.col(t)))
    return full.withColumn("rn", place).where(F.col("rn") <= k)
