"""Near copies by SimHash: blocks of wide fingerprints propose pairs, their distance sorts them, whole shingle sets decide.

At a likeness of 0.8 two fingerprints differ in 11 to 19 % of their bits, so a block is whole by chance
only. There are as many blocks as that takes, and they are only as wide as keeps their buckets
small enough to compare all fingerprints in a bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, small, staged, values
from .components import connected_components, hung
from .simhash import BROADCAST_ROWS, keep_one, wide_simhash

#: Shingles of so many words; likeness, as a fraction of whole numbers, from which two texts are near copies.
SHINGLE, LIKE = 5, (4, 5)
#: Odds at most that a bit tells two texts of likeness 0.8 apart: those of 4 shingles beside 5, for larger sets they near 0.15.
APART = 3 / 16
#: Blocks and bits in each, at least: a pair shares no block with probability (1 - (1 - APART)**5)**32 = 8e-7.
BANDS, WIDTH = 32, 5
#: Odds at most of that where blocks are wider.
MISSED = 3e-6
#: Bits by which pairs are compared, the fewest of a fingerprint, and the most in which near copies differ,
#: in their first half and in all: fewer than one pair in a million differs in more (binomial with APART).
BITS, FAR_HALF, FAR = 256, 47, 80
#: Members of a bucket, and values in their sets, that are compared in one group.
AT_ONCE, VALUES = 4096, 1 << 22
#: Texts in a block's bucket on average, at most, and fingerprints in it that are compared in one group, as multiples of AT_ONCE.
MEMBERS, PRINTS = 2, 4
#: Distances that are worked out at a time.
STEP = 1 << 19
#: Members of a crowd of close fingerprints, at least, and members of a bucket that are tried to find one.
BALL, PROBES = 64, 16


def _line(text: str | None) -> bytes:
    """A to Z lower-cased, words (what white space of ASCII separates) joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_set(line: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of ``shingle`` words; a shorter text is one run, one without words has none."""
    found = line.split()
    if not found:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip((end - size)[:n].tolist(), end[-n:].tolist())], np.uint64))


def block_plan(texts: int) -> tuple[int, int]:
    """How many blocks the fingerprints of so many texts have, and of how many bits each."""
    width = max(WIDTH, math.ceil(math.log2(max(1, texts) / (MEMBERS * AT_ONCE))))
    return max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** width)))), width


def band_keys(bits: np.ndarray, count: int, width: int) -> list[int]:
    """A number for each block of a fingerprint: equal ones are the same block with the same bits."""
    return ((bits[: count * width].reshape(count, width) @ (1 << np.arange(width, dtype=np.int64))) * count + np.arange(count)).tolist()


def _print(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def print_column(text):
    """128 bits of the text's words: equal for texts that differ in case of A to Z or in white space only, and for no others."""

    @F.arrow_udf("binary")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([_print(_line(x)) for x in values(texts)], pa.binary())

    # as if not deterministic: a join on the column would otherwise put a filter for nulls below it, which runs the function twice
    return prints.asNondeterministic()(text)


def _banded(text, shingle: int, plan: tuple[int, int]):
    """(fp, bands, sim): the print, the blocks' keys and the first BITS bits of the SimHash; the latter two null without shingles."""
    bits = max(BITS, plan[0] * plan[1])

    @F.arrow_udf("fp binary, bands array<long>, sim binary")
    def banded(texts: pa.Array) -> pa.Array:
        prints, bands, sims = [], [], []
        for line in map(_line, values(texts)):
            prints.append(_print(line))
            found = shingle_set(line, shingle)
            sim = wide_simhash(found, bits) if len(found) else None
            bands.append(None if sim is None else band_keys(sim, *plan))
            sims.append(None if sim is None else np.packbits(sim[:BITS]).tobytes())
        return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sims, pa.binary())], ["fp", "bands", "sim"])

    return banded(text)


def _sets(text, shingle: int):
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(_line(x), shingle).view(np.int64) for x in values(texts)], pa.list_(pa.int64()))

    return sets(text)


def _is_like(a: np.ndarray, b: np.ndarray, like: tuple[int, int]) -> bool:
    return (like[0] + like[1]) * len(np.intersect1d(a, b, assume_unique=True)) >= like[0] * (len(a) + len(b))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = np.asarray(column.values), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _enough(x, y, like: tuple[int, int]):
    """Whether two ascending sets have the likeness, without boxing a value in the JVM."""

    @F.arrow_udf("boolean")
    def enough(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_is_like(a, b, like) for a, b in zip(_lists(left), _lists(right))], pa.bool_())

    return enough(x, y)


def _sets_of(docs: DataFrame, text_col: str, banded: DataFrame, shingle: int) -> DataFrame:
    """(fp, bands, sim, s): the shingle set of the text of each print in ``banded`` (fp, bands, sim), as written."""
    printed = docs.select(print_column(F.col(text_col)).alias("fp"), F.col(text_col).alias("text"))
    texts = printed.join(small(banded.select("fp"), BROADCAST_ROWS), "fp").groupBy("fp").agg(F.min("text").alias("text"))
    return staged(texts.join(banded, "fp").select("fp", "bands", "sim", _sets(F.col("text"), shingle).alias("s")), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have the likeness."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), sets.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    # of sets too different in size none are compared
    sized = F.least(F.size("x"), F.size("y")).cast("long") * like[1] >= F.greatest(F.size("x"), F.size("y")).cast("long") * like[0]
    met = pairs.join(left, "a").join(right, "b").where(sized)
    return staged(met.select("a", "b", _enough(F.col("x"), F.col("y"), like).alias("ok")).where("ok").select("a", "b"), "alike")


def _sims(column: pa.Array) -> np.ndarray:
    """A row of words of 64 bits for each fingerprint."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket and chunks, one group at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
        for at, end in zip(starts, starts[1:]):
            key = keys[at].tolist()
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _balls(sims: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of the middle of a crowd that it is close to, -1 if none is found.

    PROBES of them are tried. A crowd is BALL members or more that are close to one; its middle is the
    one closest to the majority of their bits.
    """
    ball = np.full(len(sims), -1)
    for place in np.linspace(0, len(sims) - 1, PROBES).astype(int).tolist() if len(sims) > BALL else ():
        if ball[place] < 0:
            free = np.flatnonzero(ball < 0)
            inside = free[_close(sims[free], sims[place])[0]]
            if len(inside) >= BALL:
                bits = np.unpackbits(sims[inside].view(np.uint8), axis=1)
                most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(inside)).view(np.uint64)
                middle = inside[np.bitwise_count(sims[inside] ^ most).sum(axis=1).argmin()]
                ball[free[_close(sims[free], sims[middle])[0]]] = middle
    return ball


def _close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether fingerprints are close, and their distance, row by row."""
    far = np.bitwise_count(a ^ b)
    whole = far.sum(axis=1, dtype=np.int64)
    return (far[:, : far.shape[1] // 2].sum(axis=1) <= FAR_HALF) & (whole <= FAR), whole


def close_prints(sims: np.ndarray, half: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, near, before) of each fingerprint of a bucket, as places; -1 where there is none.

    Fingerprints of at most FAR differing bits, FAR_HALF in their first half, are close. ``root`` is
    one place for all that are connected so, ``near`` the closest one, ``before`` another that is close:
    the middle of the crowd it is in, which is not compared among itself, else the closest of those
    taken up before. In a bucket dealt into chunks only those of the other chunk and the crowd count
    unless it is a chunk with itself. Memory is that of STEP distances.
    """
    n, none = len(sims), np.int64(1 << 62)
    ball = _balls(sims)
    order = np.argsort(ball, kind="stable")
    sims, half, ball = sims[order], half[order], ball[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    root, near, before = np.arange(n), np.full(n, none), np.full(n, none)
    crowd = np.flatnonzero(ball >= 0)
    middle = place[ball[crowd]]
    root[crowd] = middle
    d = _close(sims[crowd], sims[middle])[1] << 32
    other = crowd != middle
    before[crowd[other]] = near[crowd[other]] = (d | middle)[other]
    np.minimum.at(near, middle[other], (d | crowd)[other])
    columns = [np.ascontiguousarray(sims[:, k]) for k in range(sims.shape[1] // 2)]
    cuts = [0, *(np.flatnonzero(np.diff(ball)) + 1).tolist(), n]
    for start, stop in zip(cuts, cuts[1:]):
        at = start
        while at < stop:
            # members of a crowd meet those before it, others all before themselves
            step = STEP // max(1, start) if ball[at] >= 0 else (math.isqrt(at * at + 4 * STEP) - at) // 2
            end = min(stop, at + max(1, step))
            upto = start if ball[at] >= 0 else end
            far = sum(np.bitwise_count(c[at:end, None] ^ c[None, :upto]) for c in columns)
            x, y = np.nonzero(far <= FAR_HALF)
            x += at
            ok = (y < x) & (single | (half[x] != half[y]))
            x, y = x[ok], y[ok]
            ok, d = _close(sims[x], sims[y])
            x, y, d = x[ok], y[ok], d[ok] << 32
            if ball[at] < 0:
                np.minimum.at(before, x, d | y)
            np.minimum.at(near, x, d | y)
            np.minimum.at(near, y, d | x)
            cut = np.flatnonzero(np.diff(x)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(x)]):
                if a == b:
                    continue
                met = np.append(root[y[a:b]], root[x[a]])
                if (met != met[0]).any():
                    root[np.isin(root, met)] = met[0]
            at = end
    back = lambda v: np.where(v == none, -1, order[v & ((1 << 32) - 1)])
    return order[root][place], back(near)[place], back(before)[place]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, band, fp, root, near, before): fingerprints close to others in a bucket; key, n and root are of those connected so."""
    for table in _groups(batches):
        if len(table) < 2:
            continue
        column = lambda c: table[c].combine_chunks()  # noqa: B023, E731
        first = [table[c][0].as_py() for c in ("key", "i", "j")]
        root, near, before = close_prints(_sims(column("sim")), table["half"].to_numpy(), first[1] == first[2])
        at = np.flatnonzero(near >= 0)
        if not len(at):
            continue
        fps = column("fp")
        name = lambda v: fps.take(pa.array(v, pa.int64(), mask=v < 0))  # noqa: B023, E731
        roots, back, n = np.unique(root[at], return_inverse=True, return_counts=True)
        keys = np.array([xxhash.xxh64_intdigest(repr((*first, r))) for r in roots.tolist()], np.uint64).view(np.int64)
        rows = [pa.array(keys[back]), pa.array(n[back]), column("band").take(pa.array(at)), name(at), name(root[at]), name(near[at]), name(before[at])]
        yield pa.record_batch(rows, ["key", "n", "band", "fp", "root", "near", "before"])


def spanning_links(rows: dict[str, np.ndarray], bands: np.ndarray, sets: list[np.ndarray], like: tuple[int, int], sims: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links, as pairs of places, that connect all members of a bucket that have the likeness and meet here first.

    ``rows`` has c (component so far), half, band and single; pairs of one component add nothing,
    pairs that share an earlier band are compared there, and of a bucket dealt into chunks only pairs
    between the two chunks count unless it is a chunk with itself. With ``sims`` only close
    fingerprints are compared. At most one link less than members is returned: what is connected
    already is not compared again. Memory is that of the rows.
    """
    band, single, half = int(rows["band"][0]), bool(rows["single"][0]), rows["half"]
    sizes = np.array([len(x) for x in sets])
    label = np.unique(rows["c"], return_inverse=True)[1]
    earlier = np.ascontiguousarray(bands[:, :band].T)
    out = []
    for i in range(len(sets) - 1):
        at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not single:
            at = at[half[at] != half[i]]
        at = at[np.minimum(sizes[at], sizes[i]) * like[1] >= np.maximum(sizes[at], sizes[i]) * like[0]]
        if sims is not None:
            at = at[_close(sims[at], sims[i])[0]]
        for own in earlier:
            if not len(at):
                break
            at = at[own[at] != own[i]]
        for j in at.tolist():
            if label[i] != label[j] and _is_like(sets[i], sets[j], like):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _compare(like: tuple[int, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            rows = {c: table[c].to_numpy() for c in ("c", "half", "band")} | {"single": np.asarray(table["i"]) == np.asarray(table["j"])}
            column = lambda c: table[c].combine_chunks()  # noqa: B023, E731
            bands = np.asarray(column("bands").values).reshape(len(table), -1)
            found = spanning_links(rows, bands, _lists(column("s")), like, _sims(column("sim")))
            if found:
                yield pa.record_batch([column("fp").take(pa.array(x, pa.int64())) for x in zip(*found)], ["a", "b"])

    return task


def _dealt(members: DataFrame, *columns: str) -> DataFrame:
    """``members`` (key, chunks, fp, ...) at each pair of chunks (i, j) of their bucket that their own, ``half``, belongs to."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "half").alias("i"), F.greatest(k, "half").alias("j")))
    dealt = members.withColumn("half", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    return dealt.select("key", "fp", "half", *columns, F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "fp", "half", *columns)


def _together(dealt: DataFrame) -> DataFrame:
    """Groups of a bucket's pair of chunks, each in one task, in order."""
    order = ["key", "i", "j"]
    return dealt.repartition(partitions(dealt.sparkSession), *order).sortWithinPartitions(*order, "fp")


def close_members(texts: DataFrame) -> DataFrame:
    """(key, n, band, fp, root, near, before) of ``texts`` (fp, bands, sim), as written, as ``_meet`` has them.

    All pairs of fingerprints in a block's bucket, but those within a crowd, are compared in bits, a bucket of more than PRINTS
    times AT_ONCE in chunks of half as many, each pair of which is a task's group.
    """
    keys = texts.select("fp", "sim", F.posexplode("bands").alias("band", "key"))
    most = PRINTS * AT_ONCE
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    full = full.select("key", F.ceil(2 * F.col("n") / most).cast("int").alias("chunks"))
    members = keys.join(small(full, BROADCAST_ROWS), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    found = _together(_dealt(members, "band", "sim")).mapInArrow(_meet, "key long, n long, band int, fp binary, root binary, near binary, before binary")
    return staged(found, "met")


def _chunks(part: int):
    """Into how many chunks n members with w values in their sets are dealt: AT_ONCE / ``part`` members each, fewer with long sets; few members are one chunk."""
    most = F.greatest(F.ceil(part * F.col("n") / AT_ONCE), F.ceil(2 * F.col("w") / VALUES)).cast("int")
    return F.when((F.col("n") <= (2 * AT_ONCE) // part) & (F.col("w") <= VALUES), F.lit(1)).otherwise(most)


def _open_members(met: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, band, fp, c, chunks): members of groups whose sets are still to be compared, c the component of ``found`` so far.

    A group is all that closeness connects, through any buckets, so a text comes once for each chunk
    of its group and not once more for each block. Groups of many members in small buckets, as long
    chains are, have fewer rows bucket by bucket and are compared so. Either way all pairs that share
    a block and are close are compared, in rows that grow with the number of members times that of chunks.
    """
    crowded = met.where("n > 2")
    close = connected_components(hung(crowded.select(F.col("fp").alias("a"), F.col("root").alias("b")))).toDF("fp", "group")
    # rows that the text has bucket by bucket
    apart = crowded.groupBy("fp").agg(F.sum(F.when(F.col("n") <= AT_ONCE, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / AT_ONCE))).alias("apart"))
    sized = apart.join(close, "fp").join(found, "fp", "left").join(sets.select("fp", F.size("s").alias("w")), "fp")
    each = staged(sized.select("fp", "group", "w", "apart", F.coalesce("component", "fp").alias("c")), "told")
    least = [F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum("w").alias("w")]
    groups = each.groupBy("group").agg(*least, F.sum("apart").alias("apart")).where("lo < hi").withColumn("chunks", _chunks(8))
    groups = staged(groups.select("group", "chunks", (F.col("n") * F.col("chunks") <= F.col("apart")).alias("once")), "open")
    told = each.select("fp", "group", "w", "c").join(small(groups, BROADCAST_ROWS), "group")
    once = told.where("once").select(F.xxhash64("group").alias("key"), F.lit(0).alias("band"), "fp", "c", "chunks")
    several = crowded.select("key", "band", "fp").join(told.where("not once").select("fp", "w", "c"), "fp")
    left = several.groupBy("key").agg(*least).where("lo < hi").select("key", _chunks(2).alias("chunks"))
    return once.unionByName(several.join(left, "key").select("key", "band", "fp", "c", "chunks"))


def near_copy_links(docs: DataFrame, banded: DataFrame, text_col: str, shingle: int, like: tuple[int, int]) -> DataFrame:
    """Links (a, b) between prints that connect all texts of the likeness that share a block and are close.

    Every member of a bucket is first compared with the closest fingerprint there, as that is the
    middle of a group of edited copies if any is, and with another (see ``close_prints``).
    What is connected by closeness, through any buckets, and left in several components by that has
    its members' sets compared in tasks, which return the links that connect more, so no pair becomes
    a row (see ``_open_members``).
    """
    texts = staged(banded.where("sim is not null").groupBy("fp").agg(F.any_value("bands").alias("bands"), F.any_value("sim").alias("sim")), "bands")
    met = close_members(texts)
    both = met.select("fp", F.explode(F.array("near", "before")).alias("other")).where("other is not null")
    pairs = both.groupBy(F.least("fp", "other").alias("x"), F.greatest("fp", "other").alias("y")).agg(F.bool_or(F.col("fp") < F.col("other")).alias("up"))
    # a is one that met b as its closest or middle, so few pairs have the same a
    stars = staged(pairs.select(F.when(F.col("up"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("up"), F.col("y")).otherwise(F.col("x")).alias("b")), "stars")
    sets = _sets_of(docs, text_col, texts.join(met.select("fp").distinct(), "fp"), shingle)
    near = _alike(stars, sets, like)
    released(stars, texts)
    found = connected_components(hung(near)).withColumnRenamed("node", "fp")
    sizes = sets.select("fp", F.size("s").alias("w"))
    members = _open_members(met, found, sets)
    whole = _dealt(members, "band", "c").join(sets, "fp").select("key", "i", "j", "band", "fp", "c", "half", "bands", "sim", "s")
    more = _together(whole).mapInArrow(_compare(like), "a binary, b binary")
    links = staged(found.select(F.col("fp").alias("a"), F.col("component").alias("b")).unionByName(more), "near")
    released(met, sets, near)
    return links


def near_copies_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the smallest id.

    Texts whose sets of ``shingle``-word shingles have a Jaccard likeness of ``like`` (0.8 or more) or more
    are linked, also through others; the likeness is exact, and a pair is compared if its SimHash
    fingerprints share one of their blocks and differ in at most FAR bits, which ``block_plan`` makes
    near certain. Null and blank texts are copies of each other, a text of fewer words is
    one shingle. Null ids, repeated rows and columns are treated as by ``simhash_keep``.
    """
    if 5 * like[0] < 4 * like[1]:
        raise ValueError("like must be 0.8 or more, which the blocks are made for")
    printed = _banded(F.col(text_col), shingle, block_plan(docs.count()))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), printed.alias("p")).select("doc_id", "p.fp", "p.bands", "p.sim"), "banded")
    found = connected_components(near_copy_links(docs, rows.select("fp", "bands", "sim"), text_col, shingle, like))
    labels = found.withColumnRenamed("node", "fp")
    each = rows.select("doc_id", "fp").join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return keep_one(docs, each, id_col, print_column(F.col(text_col)))
