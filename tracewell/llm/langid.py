"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of WINDOW bytes, each filter's
largest rectified response feeds a softmax. Once trained, a filter's response is a sum of table
entries for the bytes under it, so applying the network takes look-ups and additions only. A text
is cut into windows end to end, none is left out, and their probabilities are averaged by length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import values

WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
#: The bound of the training sample: documents of each language, windows of each document, characters of each window.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_CHARS = 500, 4, 256
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 20240229
#: Windows that are looked up at a time, so intermediate results stay in a CPU's cache.
AT_ONCE = 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes) -> bytes:
    """The text padded with zero bytes to whole windows, one at least."""
    return text.ljust(max(1, -(-len(text) // WINDOW)) * WINDOW, b"\0")


@dataclass
class Model:
    """Labels; for each offset under a filter a table of 256 rows; biases; weights and bias of the softmax."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for each row of WINDOW bytes."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), AT_ONCE):
            own = np.pad(x[at : at + AT_ONCE], ((0, 0), (0, max(WIDTHS) - 1)))
            sums = self.tables[0][own[:, :WINDOW]]
            for j, table in enumerate(self.tables[1:], 1):
                sums[:, :, -table.shape[1] :] += table[own[:, j : j + WINDOW]]
            pooled = np.maximum(sums.max(1) + self.bias, 0)
            logits = pooled @ self.weights + self.offset
            logits = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + AT_ONCE] = logits / logits.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A label and its probability for each whole text; UNKNOWN and 0 without a letter."""
        known = [bool(x) and bool(_LETTER.search(x)) and bool(self.labels) for x in texts]
        raw = [x.encode("utf-8", "replace") for x, ok in zip(texts, known) if ok]
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not raw:
            return labels, scores
        sizes = np.array([len(x) for x in raw])
        counts = -(-sizes // WINDOW)
        each = self.windows(np.frombuffer(b"".join(map(windows_of, raw)), np.uint8).reshape(-1, WINDOW)).astype(np.float64)
        weight = np.full(len(each), WINDOW, np.float64)
        last = np.cumsum(counts) - 1
        weight[last] = sizes - (counts - 1) * WINDOW
        mean = np.add.reduceat(each * weight[:, None], last - counts + 1) / sizes[:, None]
        best = mean.argmax(1)
        for i, k, p in zip(np.flatnonzero(known).tolist(), best.tolist(), mean[np.arange(len(best)), best].tolist()):
            labels[i], scores[i] = self.labels[k], round(min(1.0, p), 6)
        return labels, scores


def train(windows: np.ndarray, target: np.ndarray, labels: list[str]) -> Model:
    """Fit the network to rows of WINDOW bytes and the numbers of their labels, by Adam on cross entropy."""
    rng = np.random.default_rng(SEED)
    wide = max(WIDTHS)
    params = {"e": rng.normal(0, 0.5, (256, DIM)), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
    for w in WIDTHS:
        params[f"w{w}"], params[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (FILTERS, w * DIM)), np.zeros(FILTERS)
    params = {k: v.astype(np.float32) for k, v in params.items()}
    params["e"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, y = np.pad(windows[own], ((0, 0), (0, wide - 1))), target[own]
            rows, grads = np.arange(len(x))[:, None], {k: np.zeros_like(v) for k, v in params.items()}
            emb, pooled, places = params["e"][x], [], []
            for w in WIDTHS:
                flat = np.concatenate([emb[:, j : j + WINDOW] for j in range(w)], axis=2)
                got = flat @ params[f"w{w}"].T + params[f"b{w}"]
                place = got.argmax(1)
                places.append(place)
                pooled.append(np.maximum(got[rows, place, np.arange(FILTERS)], 0))
            hidden = np.concatenate(pooled, axis=1)
            logits = hidden @ params["v"] + params["c"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads["v"], grads["c"] = hidden.T @ p, p.sum(0)
            back = (p @ params["v"].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                g, place = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                under = place[:, :, None] + np.arange(w)
                patch = emb[rows[:, :, None], under].reshape(len(x), FILTERS, w * DIM)
                grads[f"w{w}"] = np.einsum("bf,bfk->fk", g, patch)
                grads[f"b{w}"] = g.sum(0)
                to = g[:, :, None, None] * params[f"w{w}"].reshape(FILTERS, w, DIM)[None]
                np.add.at(grads["e"], x[rows[:, :, None], under], to)
            grads["e"][0] = 0
            step += 1
            for name, grad in grads.items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                params[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    tables = []
    for j in range(wide):
        has = [w for w in WIDTHS if w > j]
        tables.append(np.concatenate([params["e"] @ params[f"w{w}"].reshape(FILTERS, w, DIM)[:, j].T for w in has], axis=1).astype(np.float32))
    bias = np.concatenate([params[f"b{w}"] for w in WIDTHS])
    return Model(labels, tables, bias, params["v"], params["c"])


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text is divisible by 5; so is one without an id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """(language, windows) of the sample that ``fit`` describes, ordered.

    Languages are counted without reading a text. One pass then takes from each language the
    documents whose hash lies below a bound that about four times the sample passes, and ranks
    those few; a language that came short of its sample has its bound lifted in a further pass.
    """
    text, id_ = F.col(text_col), F.col(id_col)
    named = docs.where(~held_out(id_) & F.col(lang_col).isNotNull()).withColumn("__tw_l", F.col(lang_col).cast("string"))
    sizes = {r[0]: r[1] for r in named.groupBy("__tw_l").agg(F.count("*")).collect()}
    slot = lambda k: F.pmod(F.xxhash64(id_, F.lit(k)), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    cut = F.array_distinct(F.array(*[F.substring(text, slot(k), F.lit(SAMPLE_CHARS)) for k in range(SAMPLE_WINDOWS)]))
    usable = named.where(F.length(F.trim(text)) > 0)
    rank = Window.partitionBy("l").orderBy("o", "w")

    def first(languages: dict[str, int]) -> list[tuple[str, list[str]]]:
        if not languages:
            return []
        bounds = F.broadcast(docs.sparkSession.createDataFrame(list(languages.items()), "__tw_k string, __tw_top long"))
        low = usable.join(bounds, F.col("__tw_l") == F.col("__tw_k")).where(F.xxhash64(id_) <= F.col("__tw_top"))
        few = low.select(F.col("__tw_l").alias("l"), F.xxhash64(id_).alias("o"), cut.alias("w"))
        return [(r.l, r.w) for r in few.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= SAMPLE_DOCS).orderBy("l", "n").collect()]

    share = {k: min(1.0, 4 * SAMPLE_DOCS / n) for k, n in sizes.items()}
    found = first({k: int(x * (2**64 - 2**11)) - 2**63 if x < 1 else 2**63 - 1 for k, x in share.items()})
    have = Counter(k for k, _ in found)
    short = {k for k, x in share.items() if x < 1 and have[k] < SAMPLE_DOCS}
    return sorted([x for x in found if x[0] not in short] + first(dict.fromkeys(sorted(short), 2**63 - 1)), key=lambda x: x[0])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``lang_col`` of the documents that are not held out.

    Of each language the SAMPLE_DOCS documents with the smallest hash of their id are taken, and of
    each SAMPLE_WINDOWS windows from places all over its text: a fixed number of short strings for
    each language reaches the driver. Null and blank texts and null languages teach nothing;
    without any language the model knows none and calls every text UNKNOWN.
    """
    found = _sample(docs, id_col, text_col, lang_col)
    labels = sorted({k for k, _ in found})
    place = {k: i for i, k in enumerate(labels)}
    pairs = [(windows_of(w.encode("utf-8", "replace")[:WINDOW]), place[k]) for k, own in found for w in own]
    if not pairs:
        return Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    return train(np.frombuffer(b"".join(x for x, _ in pairs), np.uint8).reshape(-1, WINDOW), np.array([k for _, k in pairs]), labels)


def predict(spark, model: Model, text: Column) -> Column:
    """A struct (lang, score) for a text column; only the text is looked at."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def languages(texts: pa.Array) -> pa.Array:
        labels: list[str] = []
        scores: list[float] = []
        held: list[str | None] = []
        size = 0

        def judge() -> None:
            for into, told in zip((labels, scores), shared.value.texts(held)):
                into += told
            held.clear()

        for x in values(texts):
            held.append(x)
            size += len(x or "")
            if size >= 1 << 20:
                judge()
                size = 0
        judge()
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return languages(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``doc`` (a struct of all columns), held_out, lang_pred and score of each row.

    The model is fitted on ``docs`` itself unless given. A text that is null or has no letter is
    UNKNOWN with score 0. Equal texts get equal results. Repeated rows stay; clashing column names
    are safe inside ``doc``. An empty table gives no rows.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    doc = F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc")
    told = docs.select(doc, held_out(F.col(id_col)).alias("held_out"), predict(docs.sparkSession, model, F.col(text_col)).alias("p"))
    return told.select("doc", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, languages: Iterable[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they were, whose text is recognized as one of ``languages`` (None: any learned one).

    A score of ``least`` is required: by default that the language is likelier than all others
    together. Null texts and texts without a letter go, whatever ``lang_col`` says; a text in none of
    the learned languages goes if the network finds none of them likely. Repeated rows are judged
    alike, null ids too. Where no language can be learned, or the table is empty, no row stays.
    """
    found = identify(docs, id_col, text_col, lang_col)
    named = F.lit(True) if languages is None else F.col("lang_pred").isin(*languages)
    return found.where((F.col("lang_pred") != UNKNOWN) & named & (F.col("score") >= least)).select("doc.*")
