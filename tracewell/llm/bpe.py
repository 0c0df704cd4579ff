"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list, and its inverse.

Follows tokenizer files of the kind: text normalized (NFC, white space only separates, lower
case), cut into words by a pattern, words as byte symbols of which the last bears the word's end.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

#: White space as the tokenizer's patterns know it, and its words.
BLANK = "\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+")
#: Words remembered by a worker; twice as many at most are held.
REMEMBERED = 1 << 17
#: Bytes of text that go into one batch of results.
PIECE = 2 << 20


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.vocab: dict[str, int] = dict(said["model"]["vocab"])
        self.suffix: str = said["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.text = {i: t for t, i in (self.vocab | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(said["model"]["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = [self.vocab.get(self.byte[b], -1) for b in range(256)]
        self.final = [self.vocab.get(self.byte[b] + self.suffix, -1) for b in range(256)]
        self.cut = regex.compile("|".join(f"({regex.escape(x)})" for x in self.special)) if self.special else None
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def word(self, text: str) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged, leftmost first, until none is left.

        The queue holds (rank, place, left id, right id, merged id). An entry is stale, and skipped,
        if the symbol at its place or the one after it is no longer the one it was made for.
        """
        raw = text.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue: list[tuple[int, int, int, int, int]] = []
        known = self.merges.get

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := known((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i, pair in enumerate(pairwise(ids)):
            if found := known(pair):
                queue.append((found[0], i, *pair, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _new(self, word: str) -> tuple[bytes, str]:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            ids = self.word(word)
            found = array("i", ids).tobytes(), self.decode(ids)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each word and special token of a whole text."""
        out: list[tuple[bytes, str]] = []
        for part in self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]:
            if part in self.special:
                out.append((np.array([self.special[part]], "<i4").tobytes(), part))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                get, new = self.young.get, self._new
                out += [get(word) or new(word) for word in WORD.findall(part.lower())]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(x[0] for x in self.parts(text)), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined as a file without a decoder has it: by spaces. Unknown ids are left out."""
        return " ".join([self.text[i] for i in ids if i in self.text])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _task(path: str):
    def out(doc: list, sizes: list[int], ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return pa.record_batch([pa.array(doc, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            held: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for doc, text in zip(values(batch.column(0)), values(batch.column(1))):
                parts = bpe.parts(text := text or "")
                ids = b"".join([x[0] for x in parts])
                for into, value in zip(held, (doc, len(ids) // 4, ids, " ".join([x[1] for x in parts]))):
                    into.append(value)
                size += len(text)
                if size >= PIECE:
                    yield out(*held)
                    held, size = ([], [], [], []), 0
            if held[0]:
                yield out(*held)

    return task


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: the whole text's token ids, and the text decoded from them.

    A null text counts as empty and has no ids. Special tokens written out in a text are those
    tokens. Repeated rows stay; a null id stays null. ``path`` is the tokenizer's file, the same on
    all executors. Workers remember a bounded number of words. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_task(path), "doc_id long, ids array<int>, decoded string")
