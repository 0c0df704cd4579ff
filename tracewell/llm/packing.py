"""Packing token sequences into fixed-size bins: swap-based local search over bins of equal contents.

Where a piece goes depends on its length alone, so the search runs on the histogram of lengths: a
bin is the tuple of its lengths and stands for as many bins as have the same contents. However many
pieces there are, the driver sees one count for each length and moves whole stacks of bins at once.
Pieces are numbered within their length by the tasks that cut them, without a shuffle of pieces, and
a piece's number tells its place.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged, values

CAPACITY, END = 1024, 2
#: Rows (24 bytes each) up to which the tasks' first numbers are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Fixed value: how byte-level BPE cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_BYTES = 2 << 20


def ranked(vocab: dict[str, int], merges: list, special: set[str], letters: set[str]) -> bool:
    """Whether every token is a letter or the result of one merge, and later merges have larger ids."""
    made = ["".join(x.split(" ") if isinstance(x, str) else x) for x in merges]
    ids = [vocab.get(x, -1) for x in made]
    ascending = all(a < b for a, b in zip(ids, ids[1:])) and max((vocab.get(x, -1) for x in letters), default=-1) < min(ids, default=1 << 62)
    return ascending and -1 not in ids and set(vocab) - special == set(made) | letters


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from a text to its token ids, as the tokenizers library gives them for ``path``.

    Where the vocabulary's ids are its merge ranks, a tiktoken encoding of the same vocabulary gives
    the same ids several times as fast; texts that hold a special token, or that it can't take, go
    to the tokenizers library itself, as do all texts if ids and merges do not agree.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    special = [x["content"] for x in said["added_tokens"]]
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    if not ranked(said["model"]["vocab"], said["model"]["merges"], set(special), set(byte)):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    ranks = {bytes(byte[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(x in text for x in special):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:  # noqa: BLE001  a panic of the native library is no Exception
                if type(error).__name__ != "PanicException":
                    raise
        return exact.encode(text, add_special_tokens=False).ids

    return encode


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, number long"


def _cut(path: str, capacity: int, end: int, keep_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokenizer(path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _PIECES.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(values(batch.column(0)), values(batch.column(1))):
                ids = np.array([*encode(text or ""), end], "<u4")
                at, n = 0, len(ids) % capacity or min(len(ids), capacity)
                for piece in range(-(-len(ids) // capacity)):
                    own = ids[at : at + n]
                    rows.append((doc, piece, at, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None, part, seen[n]))
                    seen[n] += 1
                    at, n = at + n, capacity
                if len(rows) >= 4096:
                    yield out()
        if rows:
            yield out()

    return task


def cut_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, part, number) of each piece of each document.

    A document is its text's token ids and then ``end``; a null text counts as empty. One longer
    than ``capacity`` is cut into pieces of that length, of which the first may be shorter. ids is
    null unless ``keep_ids``. ``number`` counts the pieces of a length from 0 within the task
    ``part`` that cut them: both hold for one run of the job, so the table is to be written before
    it is packed. A null id stays null, repeated rows are documents of their own, an empty table
    gives no rows, and other columns are not read. ``path`` is the tokenizer's file, the same on all
    executors.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_cut(path, capacity, end, keep_ids), _PIECES)


def first_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing with stacks: the longest lengths first, each into the fullest bins that take it."""
    stacks: dict[int, Counter] = {}
    frees: list[int] = []

    def put(pattern: tuple, n: int) -> None:
        free = capacity - sum(pattern)
        if free not in stacks:
            stacks[free] = Counter()
            insort(frees, free)
        stacks[free][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            free = frees[at]
            pattern, n = next(iter(stacks[free].items()))
            took = min(n, left)
            stacks[free][pattern] -= took
            if not stacks[free][pattern]:
                del stacks[free][pattern]
                if not stacks[free]:
                    del stacks[free]
                    frees.pop(at)
            put((*pattern, length), took)
            left -= took
    return sum(stacks.values(), Counter())


class _Sums:
    """What one or two of a bin's lengths add up to, as {sum: lengths} and as the bits of an integer."""

    def __init__(self, pattern: tuple, capacity: int):
        own = Counter(pattern)
        self.free = capacity - sum(pattern)
        self.one = {a: (a,) for a in own}
        self.two = {a + b: (a, b) for a, b in combinations(sorted(own), 2)} | {2 * a: (a, a) for a, n in own.items() if n > 1}
        self.bits_one = sum(1 << a for a in self.one)
        self.bits = self.bits_one | sum(1 << a for a in self.two.keys() - self.one.keys())
        self.bits_two_down = sum(1 << capacity - a for a in self.two)


def _exchange(low: _Sums, high: _Sums, capacity: int) -> tuple[tuple, tuple] | None:
    """What bin ``low`` gives and gets so that ``high`` gets fullest; None if nothing helps.

    One or two lengths go for nothing, one or two for one, one for two. All differences are worked
    out at once: a shift of an integer whose bits are sums takes one length from each of them.
    """
    gains = low.bits
    for b in high.one:
        gains |= low.bits >> b
    for a in low.one:
        gains |= high.bits_two_down >> capacity - a
    gain = (gains & (2 << high.free) - 2).bit_length() - 1
    if gain < 1:
        return None
    for give, more in ((low.one, high.two), (low.two, {})):
        for size, pieces in give.items():
            back = size - gain
            if back == 0 or back in high.one or back in more:
                return pieces, high.one.get(back) or more.get(back) or ()
    return None


def _without(pattern: tuple, gone: tuple, more: tuple) -> tuple:
    left = list(pattern)
    for x in gone:
        left.remove(x)
    return tuple(sorted([*left, *more], reverse=True))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges between underfull bins until none raises the sum of squared fills.

    A move, a one-for-one, a two-for-one or a one-for-two exchange makes the fuller bin of a pair
    fuller and the other emptier, until it is empty. Each raises the sum of squares, so the search
    ends. Stacks of equal bins exchange as one. Bins wait, the emptiest first; one that waits is
    compared with all settled ones, the fullest first, and settles once none of them exchanges with
    it. So no two settled bins ever exchange, each pair is looked at once, and a bin that comes up
    later is held against all that settled before.
    """
    done: Counter = Counter()
    open_: Counter = Counter()
    sums: dict[tuple, _Sums] = {}
    settled: list[tuple[int, tuple]] = []  # (free, pattern)
    waiting: list[tuple[int, tuple]] = []  # (fill, pattern)

    def put(pattern: tuple, n: int) -> None:
        fill = sum(pattern)
        if not n or not fill:
            return
        if fill == capacity:
            done[pattern] += n
            return
        new = pattern not in open_
        open_[pattern] += n
        if new:
            sums[pattern] = _Sums(pattern, capacity)
            heapq.heappush(waiting, (fill, pattern))
        elif open_[pattern] - n < 2 and (at := bisect_left(settled, (capacity - fill, pattern))) < len(settled) and settled[at][1] == pattern:
            # settled while it was the only one of its kind: it may exchange with its equal
            if _exchange(sums[pattern], sums[pattern], capacity):
                settled.pop(at)
                heapq.heappush(waiting, (fill, pattern))

    def take(pattern: tuple, n: int) -> None:
        open_[pattern] -= n
        if not open_[pattern]:
            del open_[pattern], sums[pattern]
            free = capacity - sum(pattern)
            at = bisect_left(settled, (free, pattern))
            if at < len(settled) and settled[at][1] == pattern:
                settled.pop(at)

    for p, n in sorted(bins.items()):
        put(tuple(sorted(p, reverse=True)), n)
    while waiting:
        fill, own = heapq.heappop(waiting)
        if own not in open_ or (at := bisect_left(settled, (capacity - fill, own))) < len(settled) and settled[at][1] == own:
            continue  # gone, or it came back while an older entry waited
        mine, free = sums[own], capacity - fill
        for other_free, other in [(free, own), *settled]:
            if other not in open_:
                continue
            n = open_[own] // 2 if other == own else min(open_[own], open_[other])
            theirs = sums[other]
            if not n:
                continue
            low, high, found = own, other, None
            if other_free <= free:
                found = _exchange(mine, theirs, capacity)
            if not found and other_free >= free:  # of two bins as full, either may become the fuller one
                low, high, found = other, own, _exchange(theirs, mine, capacity)
            if not found:
                continue
            take(low, n)
            take(high, n)
            put(_without(high, found[1], found[0]), n)
            put(_without(low, found[0], found[1]), n)
            if own not in open_ or sums[own] is not mine:
                break
        if own not in open_ or sums[own] is not mine:
            continue
        if open_[own] > 1 and _exchange(mine, mine, capacity):
            heapq.heappush(waiting, (fill, own))  # more of its kind came up meanwhile
        else:
            insort(settled, (free, own))
    return done + open_


class Plan:
    """Where the pieces of each length go, by their number within it."""

    def __init__(self, bins: Counter):
        at: Counter = Counter()
        base, keys, bases, offsets = 0, [], [], []
        for pattern, n in sorted(bins.items()):
            offset = 0
            for length in sorted(pattern, reverse=True):
                keys.append(length << 44 | at[length])
                bases.append(base - at[length])
                offsets.append(offset)
                at[length] += n
                offset += length
            base += n
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.bases, self.offsets = (np.array(x, np.int64)[order] for x in (keys, bases, offsets))
        self.bins = base

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self.keys, (length << 44) | number, "right") - 1
        return self.bases[slot] + number, self.offsets[slot]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, as ``cut_documents`` makes them, with sequence_id and offset, in as few sequences as the search finds.

    Places within a sequence have no gaps. Equal pieces are told apart by number, so repeated rows
    all find a place. An empty table gives no rows. Only counts by length reach the driver, at most
    ``capacity`` of them; the plan that goes back is as long as the stacks are varied. Pieces stay
    where they are: a task's first number for each length, a running sum over tasks, is joined to
    them, so no length is a hot key however many pieces have it. ``pieces`` is read three times and
    its numbers are made as it is written, so it has to be a written table.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(local_search(first_fit(counts, capacity), capacity))
    shared = spark.sparkContext.broadcast(plan)
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = staged(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__tw_first")), "firsts")
    numbered = pieces.join(small(firsts, BROADCAST_ROWS), ["length", "part"])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        ids, at = shared.value.places(np.asarray(length), np.asarray(number))
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(at)], ["sequence_id", "offset"])

    placed = numbered.withColumn("__tw_p", place("length", (F.col("__tw_first") + F.col("number")).cast("long")))
    own = [c for c in pieces.columns if c not in ("part", "number")]
    return placed.select(*own, "__tw_p.sequence_id", "__tw_p.offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``cut_documents`` and ``pack``: one row a piece, with its sequence and its place there.

    Null and empty texts are one piece of the end token; null ids, repeated rows, an empty table and
    other columns as in ``cut_documents``.
    """
    pieces = staged(cut_documents(docs, path, id_col, text_col, capacity=capacity, end=end, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity=capacity)
