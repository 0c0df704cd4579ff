"""How filters of documents overlap: what each removes, alone and after others, in every order of all of them.

Texts are scanned as the bytes of their Arrow buffers, a megabyte at a time and never within a word:
tables of byte classes mark capitals, symbols, blanks and first bytes of characters, and prefix sums
over the marks give the counts of each text. Prefix sums of letters times powers give each word a hash, without a
copy of the word. A text's hashes are sorted; words whose hashes are equal are compared byte by byte,
and a text in which such words differ is counted word by word, so distinct words are exact.

What a document fails is then a mask of five bits. Everything that any order of the filters removes
follows from the number of documents of each mask, so only those counts are gathered.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

U = np.uint64
#: Bytes scanned at a time.
PIECE = 1 << 20
FILTERS = "ABCDE"


@dataclass(frozen=True)
class Filters:
    """When a text fails: A too few words, B too few of them distinct, C too many capitals, D a symbol, E the text of a smaller id."""

    words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: str = "#$%&*|"


_SPACE, _CAPITAL, _FIRST = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL[0x41:0x5B] = True
_FIRST[0x80:0xC0] = False
_RANDOM = np.random.Generator(np.random.PCG64(20240311))
_LETTER = _RANDOM.integers(0, 1 << 64, 256, U)
_BASE = int(_RANDOM.integers(0, 1 << 62)) << 1 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = {base: _powers(base, PIECE + 1) for base in (_BASE, _BACK)}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers: those at hand, more only for a word longer than PIECE."""
    return _POWERS[base][:n] if n <= PIECE + 1 else _powers(base, n)


def words_of(raw: np.ndarray, lo: int, hi: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of ``raw[lo:hi]`` start and end, and a hash of each, from one prefix sum over their letters.

    ``heads`` are where texts begin: texts touch each other in a buffer, so words are parted there too.
    """
    part = raw[lo:hi]
    part_at = np.zeros(len(part) + 1, bool)
    part_at[heads - lo] = True
    part_at[[0, -1]] = True
    blank = _SPACE[part]
    start = np.flatnonzero(~blank & (part_at[:-1] | np.concatenate([[True], blank[:-1]])))
    end = np.flatnonzero(~blank & (part_at[1:] | np.concatenate([blank[1:], [True]]))) + 1
    total = np.zeros(len(part) + 1, U)
    np.cumsum(_LETTER[part] * _power(_BASE, len(part)), out=total[1:])
    value = (total[end] - total[start]) * _power(_BACK, len(part) + 1)[start]
    value ^= (end - start).astype(U) * U(0x9E3779B97F4A7C15)
    return start + lo, end + lo, value


def distinct_words(raw: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """The number of distinct words of each text: ``text`` says whose a word is."""
    order = np.lexsort((value, text))
    a, b = order[:-1], order[1:]
    twin = (text[a] == text[b]) & (value[a] == value[b])
    found = np.bincount(text, minlength=texts) - np.bincount(text[b[twin]], minlength=texts)
    a, b = a[twin], b[twin]
    differ = (end - start)[a] != (end - start)[b]
    unsure = set(text[b[differ]].tolist())
    a, b = a[~differ], b[~differ]
    size = (end - start)[a]
    upto = np.cumsum(size)
    for lo, hi in _runs(upto):
        sizes = size[lo:hi]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wrong = raw[np.repeat(start[a[lo:hi]], sizes) + within] != raw[np.repeat(start[b[lo:hi]], sizes) + within]
        if wrong.any():
            unsure.update(text[np.repeat(b[lo:hi], sizes)[wrong]].tolist())
    for t in unsure:
        own = np.flatnonzero(text == t)
        found[t] = len({raw[x:y].tobytes() for x, y in zip(start[own].tolist(), end[own].tolist())})
    return found


def _runs(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most PIECE in all, by their running total; a larger item is a range of its own."""
    at = 0
    while at < len(upto):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + PIECE, "right")))
        yield at, to
        at = to


def _cuts(raw: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A text as ranges of about PIECE bytes, none of which ends within a word."""
    while hi - lo > PIECE:
        at = lo + PIECE
        while at < hi and not (blank := np.flatnonzero(_SPACE[raw[at : min(hi, at + PIECE)]])[:1]).size:
            at = min(hi, at + PIECE)
        at = at + int(blank[0]) if at < hi else hi
        yield lo, at
        lo = at
    if hi > lo:
        yield lo, hi


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow array of strings; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def scan(column: pa.Array, filters: Filters) -> np.ndarray:
    """Of each text (a column): characters, words, distinct words, capitals, symbols (a row each)."""
    raw, at = _buffers(column)
    symbol = np.zeros(256, bool)
    symbol[list(filters.symbols.encode("ascii"))] = True
    out = np.zeros((5, len(column)), np.int64)
    for first, last in _runs(np.cumsum(np.diff(at))):
        words = []
        for lo, hi in _cuts(raw, int(at[first]), int(at[last])):
            bounds = np.clip(at[first : last + 1], lo, hi)
            for row, marks in ((0, _FIRST), (3, _CAPITAL), (4, symbol)):
                total = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(marks[raw[lo:hi]], out=total[1:])
                out[row, first:last] += np.diff(total[bounds - lo])
            words.append(words_of(raw, lo, hi, bounds))
        if words:
            start, end, value = (np.concatenate(x) for x in zip(*words))
            text = np.searchsorted(at[first : last + 1], start, "right") - 1
            out[1, first:last] = np.bincount(text, minlength=last - first)
            out[2, first:last] = distinct_words(raw, text, start, end, value, last - first)
    return out


def failing(column: pa.Array, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Bits 0 to 3 of the mask of each text (A to D), and what ``scan`` counts."""
    chars, words, distinct, capitals, symbols = found = scan(column, filters)
    fails = (words < filters.words, 100 * distinct < filters.distinct_percent * words, 100 * capitals > filters.capital_percent * chars, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails)), found


_COUNTS = ("n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", *, filters: Filters = Filters()) -> DataFrame:
    """(doc_id, part, digest, mask, n_chars, n_words, n_distinct, n_capitals, n_symbols): a row a document, one narrow pass.

    ``digest`` is the SHA-256 of the whole text, ``mask`` has bits 0 to 3 for A to D. A null text is
    empty; a null part is the empty string.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2)
            mask, counts = failing(texts, filters)
            raw, at = _buffers(texts)
            whole = memoryview(raw)
            digests = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            parts = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(mask, pa.int32()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.record_batch(parts, ["doc_id", "part", "digest", "mask", *_COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, part string, digest binary, mask int, " + ", ".join(f"{c} long" for c in _COUNTS))


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", *, filters: Filters = Filters()) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by all that they fail, E included, and how many are labelled.

    A document fails E if its text is that of a row with a smaller id. A null id is larger than any
    other, rows that share an id are no copies of each other. Rows of one id and text are counted
    before they are shuffled. The smallest id of a text is met by text and id, so a text of a third of
    all documents is a group of partial minima and never a partition. A document is good (or toxic) if
    any label of its id says 1; labels without an id count for nothing.
    """
    same = ["doc_id", "part", "digest", "mask"]
    rows = staged(measured(docs, id_col, text_col, part_col, filters=filters).groupBy(*same).agg(F.count("*").alias("n")), "measured")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    met = rows.join(firsts.select(F.col("digest").alias("d"), "first"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    full = met.select("doc_id", "part", (F.col("mask") + F.when(F.col("d").isNull(), 16).otherwise(0)).alias("mask"), "n")
    said = lambda name: F.max((F.col(name) == 1).cast("int"))
    told = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).cast("long").alias("labelled")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    both = full.where("doc_id is not null").join(told, F.col("doc_id") == F.col("labelled"), "left").select("part", "mask", "n", "good", "toxic")
    none = full.where("doc_id is null").select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    of = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(0)).alias(flag)
    return both.unionByName(none).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """What ``masked`` counts, for every part, order of the filters and step: a row each, zeros included.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    A document that fails k filters is removed by each of them in 120 / k of the 120 orders. A part has
    at most 32 masks; they are gathered, and the 600 steps read them.
    """
    steps = [(("".join(order)), k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    plan = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"own":{own},"upto":{upto}}}' for o, s, own, upto in steps) + "]"), "array<struct<o:string,s:int,own:int,upto:int>>")
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m")).select("part", "m", F.explode(plan).alias("x"))
    own, upto = F.col("x.own"), F.col("x.upto")

    def total(what, where) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, m: acc + F.when(where(m.mask), what(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    passed = lambda m: m.bitwiseAND(upto) == 0
    here = lambda m: fails(m) & passed(m)
    share = lambda m: m.n * F.expr("120").cast("long") / F.bit_count(m.mask)
    return parts.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total(lambda m: m.n, lambda m: m.bitwiseAND(upto.bitwiseOR(own)) == 0).alias("kept"), total(lambda m: m.n, here).alias("removed"),
        total(lambda m: m.n, lambda m: fails(m) & ~passed(m)).alias("redundant"), total(lambda m: m.n, lambda m: m == own).alias("unique_fails"),
        total(lambda m: m.good, here).alias("good_lost"), total(lambda m: m.toxic, here).alias("toxic_lost"),
        total(lambda m: share(m).cast("long"), fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", *, filters: Filters = Filters()) -> DataFrame:
    """``interactions`` of the five filters over all documents; an empty table gives no rows.

    ``docs`` needs an id, a text and the column that parts are made of, ``labels`` the id with quality
    and toxic; other columns are not looked at.
    """
    return interactions(masked(docs, labels, id_col, text_col, part_col, filters=filters))
