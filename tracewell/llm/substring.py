"""Substring deduplication: a merged count-min sketch first, exact grouping of what it lets through.

Four passes, none of which gathers a window's occurrences in one place:

1. Each task hashes all windows of its texts and sends the sketch cells they fall into, sorted and
   packed; cells are merged by block of the sketch into "counted twice or more".
2. The merged sketch, DEPTH rows of bits (about two to four for each window, 64 MB at most), is broadcast. Each task keeps the
   windows whose cells are all counted twice. Of a window's occurrences within one batch only those
   in the batch's smallest document are in doubt; the others are repeats at once. The ones in doubt
   are sent by hash, so a window of a third of all documents costs one entry a batch.
3. Entries are grouped by 128 bits made of keyed 128-bit digests of their words, so windows are one
   where their words are; those of larger documents than the group's smallest are repeats. Positions go
   to their documents' buckets. Where a bucket could hold more than GROUP_ENTRIES, its entries are
   first spread over parts within the same task, and documents and their positions are dealt to parts
   alike, so a task holds one part at a time however many windows or repeats there are.
4. Documents meet their positions, words under a repeated window go, the rest is joined.

The sketch only overestimates, so no repeated window is lost; what it lets through in vain is sorted
out in 3. With more windows than cells it lets more through, up to all, and results stay the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, released, slices, staged

#: Cells of a row of the sketch, as powers of two: at least one block, at most what a worker can hold.
LOG_BLOCK, LOG_MOST, DEPTH = 20, 28, 2
#: Bytes of text for each word, at least in prose; cells for each window; entries grouped at a time.
WORD_BYTES, CELLS_EACH, GROUP_ENTRIES = 6, 2, 1 << 22
#: Windows, candidates and bytes of text handled at a time.
FLUSH_WINDOWS, FLUSH_ENTRIES, PIECE = 1 << 19, 1 << 18, 1 << 19

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_CELL = (_RANDOM.integers(0, 1 << 63, DEPTH, U) << U(1) | U(1)).tolist()
#: Words whose digests a task remembers.
REMEMBERED = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


class _Digests(dict):
    """The 128-bit digest of each word, worked out once for the words at hand."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=16, key=b"substring").digest()
        return found


def word_hashes(texts: list[bytes], known: _Digests) -> tuple[np.ndarray, np.ndarray]:
    """A row of two 64-bit numbers for each word of all texts in order, and the number of words of each text.

    They are a keyed cryptographic digest, so nobody can write down words that share them.
    """
    words = [x.split() for x in texts]
    found = b"".join([known[w] for own in words for w in own])
    return np.frombuffer(found, U).reshape(-1, 2), np.array([len(x) for x in words], np.int64)


def _multipliers(window: int) -> np.ndarray:
    """Odd numbers, one for each place of a window and each half of its hash."""
    return np.random.Generator(np.random.PCG64([20240301, window])).integers(0, 1 << 63, (2, window), U) << U(1) | U(1)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice 64 bits for each run of ``window`` words, wherever it starts: each half from its own half of the words' digests."""
    n = max(0, len(words) - window + 1)
    halves = []
    for half, by_place in enumerate(_multipliers(window)):
        total = np.zeros(n, U)
        for k in range(window):
            total += by_place[k] * words[k : n + k, half]
        halves.append(_mixed(total))
    return halves[0], halves[1]


def _cells(hashes: np.ndarray, row: int, log: int) -> np.ndarray:
    return (hashes * U(_CELL[row]) >> U(64 - log)).astype(np.uint32)


def log_cells(size: int) -> int:
    """The sketch's size for a corpus of so many bytes."""
    return min(LOG_MOST, max(LOG_BLOCK, (CELLS_EACH * size // WORD_BYTES).bit_length()))


def _pack(ascending: np.ndarray) -> bytes:
    gaps = np.diff(ascending.astype(np.uint32), prepend=np.uint32(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _bytes(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts, about PIECE bytes at a time, without rows that have no id."""
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= PIECE or i + 1 == len(texts):
                own = [(a, b) for a, b in zip(ids[at : i + 1], texts[at : i + 1]) if a is not None]
                if own:
                    yield np.array([a for a, _ in own], np.int64), [b for _, b in own]
                at, size = i + 1, 0


def _starts(counts: np.ndarray, window: int) -> np.ndarray:
    """Which of the word positions (of all texts in a row) begin a window within their text."""
    ends = np.repeat(np.cumsum(counts), counts)
    n = max(0, len(ends) - window + 1)
    return np.flatnonzero(np.arange(n) + window <= ends[:n])


def _sketch(window: int, log: int):
    def rows(hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        for row in range(DEPTH):
            cells = np.sort(_cells(hashes, row, log))
            new = np.diff(cells, prepend=cells[0] ^ np.uint32(1)) != 0
            once = cells[new]
            twice = np.diff(np.append(np.flatnonzero(new), len(cells))) > 1
            cut = np.searchsorted(once, np.arange(0, (1 << log) + 1, 1 << LOG_BLOCK, dtype=np.int64))
            for block in np.flatnonzero(np.diff(cut)).tolist():
                own, more = once[cut[block] : cut[block + 1]], twice[cut[block] : cut[block + 1]]
                own = own & np.uint32((1 << LOG_BLOCK) - 1)
                yield row << (log - LOG_BLOCK) | block, _pack(own), _pack(own[more])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known = _Digests()

        def out() -> Iterator[pa.RecordBatch]:
            found = list(rows(np.concatenate(held)))
            held.clear()
            for at in range(0, len(found), 64):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found[at : at + 64]), (pa.int32(), pa.binary(), pa.binary()))], ["block", "once", "twice"])

        for _, texts in _pieces(batches):
            words, counts = word_hashes(texts, known)
            at = _starts(counts, window)
            if len(at):
                held.append(window_hashes(words, window)[0][at])
            if sum(map(len, held)) >= FLUSH_WINDOWS:
                yield from out()
        if held:
            yield from out()

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: counts of one block at a time, which stop at 2."""
    block, count = None, np.zeros(1 << LOG_BLOCK, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for now, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if now != block:
                if block is not None:
                    yield out()
                block = now
                count[:] = 0
            at = _unpack(once)
            count[at] = np.minimum(count[at] + 1, 2)
            count[_unpack(twice)] = 2
    if block is not None:
        yield out()


def _entries(window: int, sketch, buckets: int, parts: int, log: int):
    """Candidates: doubtful ones by bucket of their hash (kind 0), sure repeats by document (kind 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8).reshape(DEPTH, -1)
        held: list[tuple[np.ndarray, ...]] = []
        known = _Digests()

        def out() -> Iterator[pa.RecordBatch]:
            ids, crcs, ones, twos, places = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((twos, ones))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(ones[order]) != 0) | (np.diff(twos[order]) != 0)
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
            sure = np.empty(len(order), bool)
            sure[order] = ids[order] > least[group]
            yield from _marks(ids[sure], crcs[sure], places[sure], buckets, parts)
            doubt = ~sure
            ids, crcs, ones, twos, places = (x[doubt] for x in (ids, crcs, ones, twos, places))
            bucket = (ones >> U(40)) % U(buckets)
            order = np.lexsort((places, crcs, ids, bucket))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[b] : cut[b + 1]]
                blob = _blob(ids[own], crcs[own], places[own]) + ones[own].tobytes() + twos[own].tobytes()
                yield _row(0, b, blob, 0)

        for ids, texts in _pieces(batches):
            words, counts = word_hashes(texts, known)
            at = _starts(counts, window)
            if not len(at):
                continue
            one, two = window_hashes(words, window)
            one, two = one[at], two[at]
            keep = np.arange(len(at))
            for row in range(DEPTH):
                cell = _cells(one[keep], row, log)
                keep = keep[(bits[row][cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8) & 1).astype(bool)]
            if not len(keep):
                continue
            doc = np.repeat(np.arange(len(counts)), counts)[at[keep]]
            first = np.cumsum(counts) - counts
            crcs = np.array([zlib.crc32(x) for x in texts], np.uint32)
            held.append((ids[doc], crcs[doc], one[keep], two[keep], (at[keep] - first[doc]).astype(np.uint32)))
            if sum(len(x[0]) for x in held) >= FLUSH_ENTRIES:
                yield from out()
        if held:
            yield from out()

    return task


def _row(kind: int, bucket: int, blob: bytes, part: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([part], pa.int32())], ["kind", "bucket", "blob", "part"])


def _blob(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray) -> bytes:
    """Rows sorted by id, crc and place: each document once, with its number of places; gaps of places."""
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(crcs) != 0)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(ids))).astype(np.uint32)
    gaps = np.diff(places.astype(np.int64), prepend=0)
    gaps[at] = places[at]
    steps = np.diff(ids[at].view(U), prepend=U(0))
    planes = [steps.view(np.uint8).reshape(-1, 8).T, crcs[at].view(np.uint8).reshape(-1, 4).T, counts.view(np.uint8).reshape(-1, 4).T, gaps.astype(np.uint32).view(np.uint8).reshape(-1, 4).T]
    packed = zlib.compress(b"".join(x.tobytes() for x in planes), 1)
    return struct.pack("<III", len(at), len(ids), len(packed)) + packed


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids, crcs and places by row, and where the blob goes on."""
    docs, n, size = struct.unpack_from("<III", blob)
    raw = np.frombuffer(zlib.decompress(blob[12 : 12 + size]), np.uint8)
    back = lambda at, width, count, kind: np.ascontiguousarray(raw[at : at + width * count].reshape(width, count).T).view(kind).ravel()
    ids = np.cumsum(back(0, 8, docs, U), dtype=U).view(np.int64)
    crcs, counts = back(8 * docs, 4, docs, np.uint32), back(12 * docs, 4, docs, np.uint32)
    gaps = back(16 * docs, 4, n, np.uint32).astype(np.int64)
    total = np.cumsum(gaps)
    first = np.cumsum(counts.astype(np.int64)) - counts
    places = total - np.repeat(total[first] - gaps[first], counts)
    return np.repeat(ids, counts), np.repeat(crcs, counts), places, 12 + size


#: What tells the part of a document's bucket from the bucket.
_PART_SHIFT = 24


def _bucket_of(ids: np.ndarray, buckets: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """pmod(xxhash64(id), buckets), as Spark has it, and the part within the bucket from higher bits."""
    each, back = np.unique(ids, return_inverse=True)
    hashed = np.array([xxhash.xxh64_intdigest(struct.pack("<q", x), 42) for x in each.tolist()], U).view(np.int64)
    return (hashed % buckets)[back], ((hashed >> _PART_SHIFT) % parts)[back]


def _marks(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    bucket, part = _bucket_of(ids, buckets, parts)
    order = np.lexsort((places, crcs, ids, part, bucket))
    both = (bucket * parts + part)[order]
    cut = np.append(np.flatnonzero(np.diff(both, prepend=-1)), len(both))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[lo:hi]
        yield _row(1, int(bucket[own[0]]), _blob(ids[own], crcs[own], places[own]), int(part[own[0]]))


def _parsed(blob: bytes) -> tuple[np.ndarray, ...]:
    """Ids, crcs, places and both hashes of the entries of a doubtful row."""
    ids, crcs, places, at = _unblob(blob)
    n = len(ids)
    return ids, crcs, places, np.frombuffer(blob, np.uint8, 8 * n, at).view(U), np.frombuffer(blob, np.uint8, 8 * n, at + 8 * n).view(U)


def _spread(parts: int):
    """Rows sorted by bucket: doubtful entries of a bucket spread by their hash over so many parts; others have theirs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, crcs, places, ones, twos = (np.concatenate(x) for x in zip(*held))
            part = (ones >> U(20)) % U(parts)
            order = np.lexsort((places, crcs, ids, part))
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[p] : cut[p + 1]]
                blob = _blob(ids[own], crcs[own], places[own]) + ones[own].tobytes() + twos[own].tobytes()
                yield _row(0, bucket, blob, p)

        for batch in slices(batches):
            for kind, now, blob, part in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob", "part"))):
                if kind == 1:
                    yield _row(1, now, blob, part)
                    continue
                if held and (now != bucket or size >= FLUSH_ENTRIES):
                    yield from out()
                    held, size = [], 0
                bucket = now
                held.append(_parsed(blob))
                size += len(held[-1][0])
        if held:
            yield from out()

    return task


def _group(buckets: int, parts: int):
    """Rows sorted by bucket of the hash and part of it: exact groups within a part, repeats by document.

    Rows of kind 1 know their document already and pass.
    """

    def repeats(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, crcs, places, ones, twos = (np.concatenate(x) for x in zip(*map(_parsed, blobs)))
        order = np.lexsort((twos, ones))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ones[order]) != 0) | (np.diff(twos[order]) != 0)
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        gone = order[ids[order] > least[np.cumsum(new) - 1]]
        return ids[gone], crcs[gone], places[gone]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, found = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                own = [np.concatenate(x) for x in zip(*found)]
                found.clear()
                yield from _marks(*own, buckets, parts)

        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), 1))
            if len(known):
                yield known.select(["kind", "bucket", "blob", "part"])
            doubtful = batch.filter(pc.equal(batch.column("kind"), 0))
            for *now, blob in zip(*(doubtful.column(c).to_pylist() for c in ("bucket", "part", "blob"))):
                if now != bucket and blobs:
                    found.append(repeats(blobs))
                    blobs = []
                    if sum(len(x[0]) for x in found) >= FLUSH_ENTRIES:
                        yield from out()
                bucket = now
                blobs.append(blob)
        if blobs:
            found.append(repeats(blobs))
        yield from out()

    return task


def _apply(window: int, id_at: int, text_at: int):
    """Rows sorted by bucket and part of the id, positions before documents: a part's positions are held at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, marks = None, [], None
        for batch in slices(batches):
            docs = pa.array([x == 2 for x in batch.column("kind").to_pylist()])
            spans, n_words, n_gone, kept = [], [], [], []
            ids, texts = batch.column("doc").field(id_at).to_pylist(), _bytes(batch.column("doc").field(text_at))
            for i, (kind, *now, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "part", "blob")))):
                if now != bucket:
                    bucket, blobs, marks = now, [], None
                if kind != 2:
                    blobs.append(blob)
                    continue
                if marks is None:
                    marks = _by_document(blobs)
                    blobs = []
                words = texts[i].split()
                places = marks.get((ids[i], zlib.crc32(texts[i])))
                gone = np.zeros(len(words), bool)
                if places is not None:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + window, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                n_words.append(len(words))
                n_gone.append(int(gone.sum()))
                kept.append(b" ".join(words if places is None else [words[k] for k in np.flatnonzero(~gone).tolist()]))
            rows = batch.filter(docs)
            yield pa.record_batch([rows.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc", "n_words", "n_removed", "kept_text", "removed"])

    return task


def _by_document(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    if not blobs:
        return {}
    ids, crcs, places = (np.concatenate(x) for x in zip(*[_unblob(b)[:3] for b in blobs]))
    order = np.lexsort((places, crcs, ids))
    ids, crcs, places = ids[order], crcs[order], places[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(crcs) != 0)
    cut = np.append(np.flatnonzero(new), len(ids))
    return {(int(ids[a]), int(crcs[a])): places[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())}


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13) -> DataFrame:
    """One row a document: ``doc`` (a struct of all its columns), n_words, n_removed, kept_text, removed.

    Words are what ASCII white space separates. A word is removed if a window of ``window``
    consecutive words covers it whose word sequence also starts in a document with a smaller id, as
    the input has them. kept_text is the words left, joined by one space; removed lists word spans
    (start, end). Null and empty texts have no words. Rows without an id neither lose words nor
    make others lose any. Rows that share an id are not repeats of each other; each keeps its own
    marks, told apart by the text's CRC-32. Ids are longs. Clashing column names are safe inside
    ``doc``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    buckets = 4 * count
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log, parts = log_cells(size), -(-size // WORD_BYTES // (buckets * GROUP_ENTRIES)) or 1
    packed = texts.mapInArrow(_sketch(window, log), "block int, once binary, twice binary")
    merged = packed.repartition(count, "block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    sketch = np.zeros(DEPTH << (log - 3), np.uint8)
    blocks = staged(merged, "sketch")
    for row in blocks.toLocalIterator():  # at most DEPTH << (log - LOG_BLOCK) rows of 128 KB
        at = row["block"] << (LOG_BLOCK - 3)
        sketch[at : at + (1 << (LOG_BLOCK - 3))] = np.frombuffer(row["bits"], np.uint8)
    released(blocks)
    shared = spark.sparkContext.broadcast(sketch.tobytes())
    fields = "kind int, bucket int, blob binary, part int"
    sent = texts.mapInArrow(_entries(window, shared, buckets, parts, log), fields)
    dealt = sent.repartition(count, "bucket").sortWithinPartitions("bucket")
    if parts > 1:
        dealt = dealt.mapInArrow(_spread(parts), fields).sortWithinPartitions("bucket", "part")
    marks = dealt.mapInArrow(_group(buckets, parts), fields)
    hashed = F.xxhash64(F.col(id_col).cast("long"))
    key, part = F.pmod(hashed, F.lit(buckets)).cast("int"), F.pmod(F.shiftright(hashed, _PART_SHIFT), F.lit(parts)).cast("int")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    whole = docs.select(F.lit(2).alias("kind"), key.alias("bucket"), F.lit(None).cast("binary").alias("blob"), part.alias("part"), row.alias("doc"))
    kind = whole.schema["doc"].dataType
    met = marks.withColumn("doc", F.lit(None).cast(kind)).unionByName(whole)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([
        T.StructField("doc", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("removed", span),
    ])
    return met.repartition(count, "bucket").sortWithinPartitions("bucket", "part", "kind").mapInArrow(_apply(window, docs.columns.index(id_col), docs.columns.index(text_col)), schema)
