"""Personal data found by form, and the terms that would give it away by how the corpus uses them.

1. Emails, addresses, card and phone numbers are found in whole texts, each by a scan that is linear
   in the text's length. These are the protected entities; their spans always stay.
2. Each occurrence of an entity has a context, the CONTEXT terms (words, lower case) on each side. Terms
   and their shapes (what a term is generalised to) are counted with the entity: in how many documents they
   meet, and in how many kinds of context. Contexts are of a kind if the smallest hash of their pairs of
   neighbouring terms is equal, so copies of a passage, a word changed or not, are one kind.
3. Of a pair with SUPPORT kinds or more, and as many as half of its texts, the pointwise mutual
   information is held against the information content of the entity: log2 of N df(c, t) / (df(c) df(t)) by log2 of
   N / df(c). That share is 1 where a term is used with the entity only, and 0 where they are independent.
4. A term whose share reaches the THRESHOLD discloses the entity. In every document that holds the entity
   the term is generalised to its shape, wherever it stands, or removed if the shape discloses an
   entity of that document too. Documents without an entity keep all their terms.

Only pairs in contexts are made, 4 * CONTEXT an occurrence at most and only for entities with enough kinds of
context, so neither long documents nor an entity of a third of all documents make pairs by the square.
Texts are told apart by their SHA-256 and treated alike where they are equal.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small, staged, values

KINDS = ("email", "ip", "card", "phone")
#: Terms on each side of an entity, kinds of context that a pair needs, and the share of an entity's information that discloses it.
CONTEXT, SUPPORT, THRESHOLD = 12, 3, 0.8
#: Terms and pairs that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows that a task gives out at a time.
FLUSH = 1 << 13

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number's first digit begins it: none begins within a run of digits, as that run's own start would do as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: A term: letters and digits, joined by single marks.
_TERM = re.compile(r"[^\W_]+(?:[.'’_-][^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))
#: What a base span is replaced by.
TAGS = {k: f"[{k.upper()}]" for k in KINDS}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it, two labels or more behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at
        if found:
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the personal data of a text, by kind and then by start, in code points."""
    found = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def entity(kind: int, text: str) -> str:
    """An entity as it is counted: however it was written, kind and value."""
    value = text.lower() if kind == 0 else ".".join(x.lstrip("0") or "0" for x in text.split(".")) if kind == 1 else _digits(text)
    return f"{KINDS[kind]}:{value}"


def shape(term: str) -> str:
    """What a term is generalised to: its runs of letters and of digits, each as one character."""
    if term.isalpha():
        return "<a>"
    for pattern, sign in _SHAPE:
        term = pattern.sub(sign, term)
    return f"<{term}>"


def terms(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of a text's terms with a letter, in lower case, that touch no span; ``spans`` are sorted."""
    at = 0
    for m in _TERM.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if (at == len(spans) or spans[at][0] >= end) and _LETTER.search(m[0]):
            yield m[0].lower(), start, end


def term_set(text: str) -> set[str]:
    """The distinct terms of a text, as ``terms`` with the text's own spans gives them."""
    if base := base_spans(text):
        return {t for t, _, _ in terms(text, _merged(base))}
    return {t.lower() for t in set(_TERM.findall(text)) if t.isalpha() or _LETTER.search(t)}


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((a, b) for _, a, b in found):
        if out and start < out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _name(shape_or_term: str) -> bytes:
    return hashlib.blake2b(shape_or_term.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def contexts(text: str, found: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[str, str, int]]:
    """(entity, its context's terms joined by blanks, the context's kind) of a text's occurrences of entities.

    The terms of the text are listed once; an occurrence takes ``reach`` before and behind it.
    """
    own = list(terms(text, _merged(found)))
    starts = [s for _, s, _ in own]
    for kind, start, end in found:
        at = bisect_left(starts, start)
        near = [t for t, _, _ in own[max(0, at - reach) : at + reach]]
        least = min((_name(f"{a} {b}") for a, b in zip(near, near[1:])), default=_name(" ".join(near)))
        yield entity(kind, text[start:end]), " ".join(near), int.from_bytes(least, "big", signed=True)


def key_of(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _rows(made, schema: pa.Schema):
    """A task for ``mapInArrow`` over one column of texts: the rows that ``made`` gives for each, FLUSH at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema.names)
        rows: list[tuple] = []
        for batch in slices(batches):
            for text in values(batch.column(0)):
                for row in made(text) if text else ():
                    rows.append(row)
                    if len(rows) >= FLUSH:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return task


def occurrences(texts: DataFrame, reach: int = CONTEXT) -> DataFrame:
    """(text_key, entity, near, kind, n): the contexts of entities in each distinct text, and how many documents have it."""

    def made(text: str) -> Iterator[tuple]:
        if found := base_spans(text):
            key = key_of(text)
            for row in dict.fromkeys(contexts(text, found, reach)):
                yield key, *row

    schema = pa.schema([("text_key", pa.binary()), ("entity", pa.string()), ("near", pa.string()), ("kind", pa.int64())])
    rows = texts.mapInArrow(_rows(made, schema), "text_key binary, entity string, near string, kind long")
    return rows.groupBy("text_key", "entity", "near", "kind").agg(F.count("*").alias("n"))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term of a context and its shape, which has none itself."""
    names = ["text_key", "entity", "kind", "n", "term", "shape"]
    for batch in slices(batches):
        near = [sorted({x for t in text.split(" ") if t for x in ((t, shape(t)), (shape(t), None))}, key=str) for text in values(batch.column("near"))]
        at = pa.array([i for i, own in enumerate(near) for _ in own], pa.int64())
        flat = [x for own in near for x in own]
        yield pa.record_batch([*(batch.column(c).take(at) for c in names[:4]), pa.array([t for t, _ in flat], pa.string()), pa.array([s for _, s in flat], pa.string())], names)


def _counted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df_term): in how many documents each wanted term or shape is; the terms of all documents are looked at.

    Wanted terms that are few enough are broadcast to where texts are read; more are joined with the
    terms of the texts, each once a text and summed in the tasks first.
    """
    spark = texts.sparkSession
    few = [r[0] for r in wanted.limit(BROADCAST_ROWS + 1).collect()]
    names = spark.sparkContext.broadcast(frozenset(few)) if len(few) <= BROADCAST_ROWS else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = names.value if names is not None else None
        shaped = only is None or any(x.startswith("<") for x in only)
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return made

        for batch in slices(batches):
            for text in values(batch.column(0)):
                if not text:
                    continue
                own = term_set(text)
                if shaped:
                    own |= {shape(t) for t in own}
                counts.update(own if only is None else own & only)
                if len(counts) >= 8 * FLUSH:
                    yield out()
        if counts:
            yield out()

    summed = texts.mapInArrow(task, "term string, n long").groupBy("term").agg(F.sum("n").alias("df_term"))
    return summed if names is not None else summed.join(wanted, "term", "left_semi")


def disclosing(texts: DataFrame, found: DataFrame, *, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, shape, df_entity, df_term, df_both, kinds, share): the pairs that give an entity away.

    ``found`` is a written table of ``occurrences`` of the texts. Shapes are among the terms, their own
    ``shape`` is null. ``share`` is pointwise mutual information by information content.
    """
    total = texts.count()
    often = found.groupBy("entity", "kind").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("k")).where(F.col("k") >= support)
    looked = found.join(small(staged(often, "entities"), BROADCAST_ROWS), "entity", "left_semi")
    pairs = staged(looked.mapInArrow(_paired, "text_key binary, entity string, kind long, n long, term string, shape string").distinct(), "pairs")
    of_text = pairs.groupBy("entity", "term", "shape", "text_key").agg(F.max("n").alias("n")).groupBy("entity", "term", "shape").agg(F.sum("n").alias("df_both"), F.count("*").alias("texts"))
    of_kind = pairs.groupBy("entity", "term", "kind").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("kinds"))
    both = staged(of_text.join(of_kind, ["entity", "term"]).where((F.col("kinds") >= support) & (2 * F.col("kinds") >= F.col("texts"))), "both")
    entities = found.groupBy("entity", "text_key").agg(F.max("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("df_entity"))
    told = both.join(entities, "entity").join(_counted(texts, both.select("term").distinct()), "term")
    content = F.log2(F.lit(float(total)) / F.col("df_entity"))
    mutual = F.log2(F.lit(float(total)) * F.col("df_both") / (F.col("df_entity") * F.col("df_term")))
    # an entity of every document has no information to give away
    scored = told.withColumn("share", F.when(content > 0, mutual / content).otherwise(0.0))
    return scored.where(F.col("share") >= threshold).select("entity", "term", "shape", "df_entity", "df_term", "df_both", "kinds", "share")


def _by_text(texts: DataFrame, found: DataFrame, bad: DataFrame) -> DataFrame:
    """(text_key, terms, shapes): what is disclosing in each text that holds such an entity, of what the text has.

    Terms of texts with entities meet the pairs by term, so an entity's terms are never dealt to all of
    its texts.
    """

    def made(text: str) -> Iterator[tuple]:
        if base_spans(text):
            key, own = key_of(text), term_set(text)
            for t in own | {shape(t) for t in own}:
                yield key, t

    schema = pa.schema([("text_key", pa.binary()), ("term", pa.string())])
    own = texts.mapInArrow(_rows(made, schema), "text_key binary, term string").distinct()
    holds = found.select("text_key", "entity").distinct()
    hit = own.join(bad.select("entity", "term"), "term").join(holds, ["text_key", "entity"], "left_semi")
    is_shape = F.col("term").startswith("<")
    return hit.groupBy("text_key").agg(F.collect_set(F.when(~is_shape, F.col("term"))).alias("terms"), F.collect_set(F.when(is_shape, F.col("term"))).alias("shapes"))


def cleaned(text: str, base: list[tuple[int, int, int]], bad: set[str], shapes: set[str]) -> tuple[list[tuple[str, int, int, str]], str]:
    """All spans with what stands there then, and the text with each replaced; base spans that overlap are one edit."""
    whole = _merged(base)
    more = [(a, b, "" if shape(t) in shapes else shape(t)) for t, a, b in terms(text, whole) if t in bad] if bad else []
    tags: dict[int, str] = {}
    for kind, a, _ in base:
        tags.setdefault(a, TAGS[KINDS[kind]])
    out, at = [], 0
    for a, b, shown in sorted([(a, b, tags[a]) for a, b in whole] + more):
        out += text[at:a], shown
        at = b
    spans = [(KINDS[k], a, b, TAGS[KINDS[k]]) for k, a, b in base]
    spans += [("generalised", a, b, s) for a, b, s in more if s] + [("removed", a, b, s) for a, b, s in more if not s]
    return spans, "".join([*out, text[at:]])


def sanitised(docs: DataFrame, text_col: str = "text", *, reach: int = CONTEXT, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: ``doc`` (a struct of all its columns), ``spans`` (kind, start, end, shown) and ``clean_text``.

    Spans of KINDS come first, by kind and start, then those of terms, ``generalised`` or ``removed``, by
    kind and start; starts and ends are code points, ends exclusive. ``shown`` stands there in
    clean_text. A null text is empty. Repeated rows and null ids count as documents of their own; an
    empty table gives no rows. Clashing column names are safe inside ``doc``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    texts = docs.select(text)
    found = staged(occurrences(texts, reach), "occurrences")
    bad = staged(disclosing(texts, found, support=support, threshold=threshold).select("entity", "term"), "disclosing")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text)
    few = bad.limit(BROADCAST_ROWS + 1).collect()
    shared = None
    if len(few) <= BROADCAST_ROWS:
        of: dict[str, tuple[set[str], set[str]]] = {}
        for name, term in few:
            of.setdefault(name, (set(), set()))[term.startswith("<")].add(term)
        shared = spark.sparkContext.broadcast(of)
        none = F.lit(None).cast("array<string>")
        met = row.withColumn("terms", none).withColumn("shapes", none)
    else:
        keyed = row.withColumn("text_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        met = keyed.join(_by_text(texts, found, bad), "text_key", "left").select("doc", "text", "terms", "shapes")
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("shown", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, clean = [], []
            for text, own, shapes in zip(*(values(batch.column(c)) for c in ("text", "terms", "shapes"))):
                base = base_spans(text)
                if shared is not None:
                    known = [shared.value[e] for e in {entity(k, text[a:b]) for k, a, b in base} if e in shared.value] if base else []
                    own, shapes = (set().union(*(x[i] for x in known)) for i in (0, 1))
                one, shown = cleaned(text, base, set(own or ()), set(shapes or ()))
                spans.append([dict(zip(("kind", "start", "end", "shown"), x)) for x in one])
                clean.append(shown)
            yield pa.record_batch([batch.column("doc"), pa.array(spans, pa.list_(span)), pa.array(clean, pa.string())], ["doc", "spans", "clean_text"])

    parts = [T.StructField(n, k) for n, k in (("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("shown", T.StringType()))]
    schema = T.StructType([T.StructField("doc", row.schema["doc"].dataType), T.StructField("spans", T.ArrayType(T.StructType(parts))), T.StructField("clean_text", T.StringType())])
    return met.mapInArrow(task, schema)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
