"""WARC archives: writing records with Spark's text sink, reading them back by verified boundary chains.

An archive is uncompressed: each record begins with the magic line, names its length and ends with
two line breaks. A payload may hold the magic too, so finding it proves nothing. Reading takes
every magic for a candidate, whose header gives the offset of its successor, and keeps only what
the chain of successors reaches from the start of the file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, shared_dir, slices, small, staged

MAGIC = b"WARC/1.0\r\n"
#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Grid in which segments are matched to the records they continue.
CELL = 64 << 20
#: Payloads from this size on may be replaced by a reference to an equal one.
LEAST_REVISIT = 100


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("null")), r"[\r\n]", " "), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", records_per_file: int = 16384) -> None:
    """Write one record for each row of ``pages`` to files below ``path``.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at least LEAST_REVISIT
    bytes the row with the smallest id is a ``response``, the others are ``revisit`` records
    without a body that refer to it; rows that share that id and payload are responses alike. A
    null id is written as ``null`` and counts as larger than any other. Line breaks in a URL become
    spaces, a null URL ``null``. Only digests are shuffled; payloads go from the scan to the file.
    """
    id_, body = F.col(id_col).cast("long"), F.coalesce(F.col(payload_col), F.lit(""))
    short = pages.select(id_.alias("id"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= LEAST_REVISIT)
    firsts = short.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = short.join(firsts, "digest").where("id is null or id <> first").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    again = small(staged(again, "revisits"), BROADCAST_ROWS)
    full = pages.select(id_.alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size"))
    told = full.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", name(F.col("first"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    told.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


_SEGMENT = "file string, file_size long, block long, idx long, at long, size long, next long, run long, alone boolean, head binary, payload_size long, payload_sha256 string"


def _parsed(record: bytes) -> tuple[bytes, int] | None:
    """Header (without the magic) and block length of a record whose bytes begin with ``record``."""
    head, mark, _ = record.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n") if mark else ():
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            return head, int(value)
    return None


def payload_of(record: bytes) -> bytes:
    """The payload of a whole record (without the magic): its block, less the HTTP header of an HTTP block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    block = rest[: _parsed(record)[1]]
    return block.partition(b"\r\n\r\n")[2] if b"application/http" in head.lower() else block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands between two magics, in file order: ``at`` is relative to the split's first magic.

    ``next`` is where the record says it ends, null without a readable header. ``run`` numbers
    stretches of the split in which each candidate's successor is the next candidate. A segment
    that is a record alone has its payload measured here, and its bytes go no further.
    """
    now, idx, at, run, expected = None, 0, 0, 0, None
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    for batch in slices(batches):
        rows: list[tuple] = []
        for value, file, size, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "file_size", "block"))):
            if (file, block) != now:
                now, idx, at, expected = (file, block), 0, 0, None
            first = block == 0 and idx == 0  # before the first magic
            found = None if first else _parsed(value)
            end = at + len(MAGIC) + len(found[0]) + 4 + found[1] + 4 if found else None
            here = at + len(MAGIC) + len(value)
            alone = end == here
            run += expected != at
            body = payload_of(value) if alone else b""
            rows.append((file, size, block, idx, at, len(value), end, run, alone, found[0] if found else None, len(body) if alone else None, hashlib.sha256(body).hexdigest() if alone else None))
            expected, idx, at = end, idx + 1, here
        if rows:
            kinds = [pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.binary(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"))


def _reached(targets: DataFrame) -> DataFrame:
    """(file, at) reachable from offset 0; ``targets`` has (file, at, to) with one row for each (file, at).

    Pointer jumping: each round every pointer is followed by itself once more and what reached
    offsets point at is reached too, so a chain of n takes log2(n) rounds.
    """
    now = staged(targets.withColumn("hit", F.col("at") == 0), "chain")
    hits = -1
    while (found := now.where("hit").count()) != hits:
        hits = found
        a, b = now.alias("a"), now.alias("b")
        both = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")), "left")
        moved = both.select("a.file", "a.at", F.col("b.to").alias("to"), "a.hit")
        marked = now.where("hit and to is not null").select("file", F.col("to").alias("at"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("hit"))
        merged = moved.withColumn("own", F.lit(True)).unionByName(marked.withColumn("own", F.lit(False)))
        after = staged(merged.groupBy("file", "at").agg(F.max("to").alias("to"), F.max("hit").alias("hit"), F.max("own").alias("own")).where("own").drop("own"), "chain")
        released(now)
        now = after
    return now.where("hit").select("file", "at")


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Fix what the size of splits depends on, so scans agree even if executors come or go between them."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(key)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, head binary, payload_size, payload_sha256) of each record below ``path``.

    Only records on the chain from the start of their file are returned; a magic inside a payload
    belongs to the payload. A record that the end of its file cuts off is left out, and so is
    whatever follows a broken header. A file that does not begin with the magic has no records, nor
    has an empty folder. ``head`` is the header's lines; measures are of the whole payload. All
    scans run before this returns, under one layout of splits.
    """
    with _same_splits(spark):
        return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    parts = staged(_scan(spark, path).mapInArrow(_segments, _SEGMENT), "segments")
    per = parts.groupBy("file", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select("file", "block", (earlier("bytes") + len(MAGIC) * (earlier("n") - 1)).alias("base"))
    each = parts.join(base, ["file", "block"]).select("file", "file_size", "block", "idx", "run", "alone", "size", "head", "payload_size", "payload_sha256", (F.col("at") + F.col("base")).alias("at"), (F.col("next") + F.col("base")).alias("to"))
    each = staged(each, "candidates")
    runs = each.groupBy("file", "block", "run").agg(F.max_by("to", "at").alias("exit"))
    ends = runs.where("exit is not null").select("file", F.col("exit").alias("at")).unionByName(each.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    entry = ends.join(each.where("to is not null").select("file", "at", "block", "run"), ["file", "at"]).join(runs, ["file", "block", "run"])
    entry = staged(entry, "entries")
    reached = _reached(entry.select("file", "at", F.col("exit").alias("to")))
    since = entry.join(reached, ["file", "at"]).groupBy("file", "block", "run").agg(F.min("at").alias("since"))
    records = staged(each.join(since, ["file", "block", "run"]).where("at >= since and to is not null and to <= file_size"), "records")
    whole = records.where("alone")
    split = records.where("not alone").select("file", F.col("at").alias("offset"), "to", "head")
    out = whole.select("file", F.col("at").alias("offset"), (F.col("to") - F.col("at")).alias("length"), "head", "payload_size", "payload_sha256")
    if split.isEmpty():
        return out
    grid = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {CELL}"), F.expr(f"{b} div {CELL}")))
    spans = split.select("file", "offset", "to", "head", grid("offset", "to").alias("cell"))
    held = each.select("file", "block", "idx", "at", F.expr(f"at div {CELL}").alias("cell"))
    need = held.join(spans, ["file", "cell"]).where("at >= offset and at < to").select("file", "block", "idx", "at", "offset", "to", "head")
    need = staged(need, "continued")
    again = _scan(spark, path).mapInArrow(_numbered, "file string, block long, idx long, value binary")
    got = again.join(small(need, BROADCAST_ROWS), ["file", "block", "idx"])
    joined = got.groupBy("file", "offset", "to", "head").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    measured = joined.select("file", "offset", (F.col("to") - F.col("offset")).alias("length"), "head", _measured(F.col("parts.value"), F.col("to") - F.col("offset")).alias("m"))
    return out.unionByName(staged(measured.select("file", "offset", "length", "head", "m.payload_size", "m.payload_sha256"), "joined"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their number within the split, as ``_segments`` counts them."""
    now, idx = None, 0
    for batch in slices(batches):
        keys, numbers = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())), []
        for key in keys:
            idx = idx + 1 if key == now else 0
            now = key
            numbers.append(idx)
        yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(numbers, pa.int64()), batch.column("value")], ["file", "block", "idx", "value"])


def _measured(parts: Column, length: Column) -> Column:
    """Size and SHA-256 of the payloads of records put together from their segments; fails if the splits were cut otherwise than before."""

    @F.arrow_udf("payload_size long, payload_sha256 string")
    def measured(segments: pa.Array, lengths: pa.Array) -> pa.Array:
        sizes, digests = [], []
        for own, n in zip(segments, lengths.to_pylist()):
            record = MAGIC.join(own.as_py())
            if len(record) + len(MAGIC) != n:
                raise ValueError("the archive changed, or its splits did, between two reads")
            body = payload_of(record)
            sizes.append(len(body))
            digests.append(hashlib.sha256(body).hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["payload_size", "payload_sha256"])

    return measured(parts, length)


def field(head: Column, name: str) -> Column:
    """A header field as a string, null where there is none."""
    found = F.regexp_extract(head.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
