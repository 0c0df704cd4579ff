"""Whole rows without secrets: every text of a row, however nested, redacted; and rows cut down to what may be kept.

Secrets that are known as they are, in all their spellings, are found by one automaton that reads a
text once however many there are; where they overlap each other or what redaction finds, the union
of the spans is masked.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, quote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import redact

try:
    import ahocorasick
except ImportError:  # one alternation of all spellings then
    ahocorasick = None


def variants(secret: str) -> list[str]:
    """How a secret may be written: as it is, percent-encoded in either case, as JSON has it, and in Base64; longest first."""
    raw = secret.encode()
    forms = {secret, quote(secret, safe=""), quote_plus(secret), json.dumps(secret)[1:-1], json.dumps(secret, ensure_ascii=False)[1:-1], base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("=")}
    forms |= {re.sub("%[0-9A-F]{2}", lambda m: m[0].lower(), x) for x in forms}
    return sorted((x for x in forms if len(x) >= 4), key=lambda x: (-len(x), x))


def finder(secrets: list[str]) -> Callable[[str], list[redact.Span]]:
    """A function from a text to the spans of all spellings of all secrets in it, overlapping ones joined."""
    words = {v for s in secrets for v in variants(s)}
    if not words:
        return lambda text: []
    masked = lambda text, a, b: redact.Span(a, b, redact.MARK + "\n" * text.count("\n", a, b))
    if ahocorasick is None:
        pattern = re.compile("|".join(map(re.escape, sorted(words, key=lambda x: (-len(x), x)))))
        return lambda text: [masked(text, *m.span()) for m in pattern.finditer(text)]
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, len(word))
    automaton.make_automaton()

    def spans(text: str) -> list[redact.Span]:
        out: list[list[int]] = []
        for start, end in sorted((last + 1 - size, last + 1) for last, size in automaton.iter(text)):
            if out and start < out[-1][1]:
                out[-1][1] = max(end, out[-1][1])
            else:
                out.append([start, end])
        return [masked(text, a, b) for a, b in out]

    return spans


def _texts(array: pa.Array, mask: Callable[[str], str]) -> pa.Array:
    """``array`` with ``mask`` over each string in it, in structs, arrays and values of maps too; nulls and keys of maps stay."""
    kind = array.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([None if x is None else mask(x) for x in array.to_pylist()], kind)
    if pa.types.is_struct(kind) and kind.num_fields:
        children = [_texts(x, mask) for x in array.flatten()]
        return pa.StructArray.from_arrays(children, fields=[pa.field(f.name, c.type) for f, c in zip(kind, children)], mask=array.is_null())
    if pa.types.is_map(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind):
        array = pa.concat_arrays([array, array.slice(0, 0)])  # a slice of a longer one becomes whole
        at, there = np.asarray(array.offsets), np.asarray(array.is_valid())
        offsets = pa.array(at, mask=np.append(~there, False), type=pa.int64() if pa.types.is_large_list(kind) else pa.int32())
        if pa.types.is_map(kind):
            return pa.MapArray.from_arrays(offsets, array.keys, _texts(array.items, mask))
        return (pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray).from_arrays(offsets, _texts(array.values, mask))
    return array


def scrubbed(rows: DataFrame, secrets: list[str]) -> DataFrame:
    """``rows`` with every text, nested ones too, redacted, and the given secrets masked in any of their spellings.

    ``secrets`` is a short list of what this session knows itself. Keys of maps, numbers and nulls stay.
    A text is searched again after it was masked, as what was taken out may have parted a secret.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(secrets)

        def mask(text: str) -> str:
            exact = find(text)
            if exact or redact.maybe(text):
                text = redact.redact(text, exact)[0]
                text = redact.applied(text, find(text))[0]
            return text

        for batch in batches:
            yield pa.record_batch([_texts(c, mask) for c in batch.columns], names=batch.schema.names)

    return rows.mapInArrow(task, schema)


def kept(rows: DataFrame, fields: dict[str, int]) -> DataFrame:
    """``rows`` cut down to ``fields``: texts redacted and then cut to so many characters, arrays to so many elements; the rest as it is."""
    out = []
    for name, most in fields.items():
        kind = rows.schema[name].dataType
        value = F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            value = F.substring(redact.redact_column(F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")).getField("content"), 1, most)
        elif isinstance(kind, T.ArrayType):
            value = F.slice(value, 1, most)
        out.append(value.alias(name))
    return rows.select(*out)
