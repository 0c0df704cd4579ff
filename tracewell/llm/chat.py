"""Chat formatting in budgeted windows, and reading the turns and the loss text back.

A turn is ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line break. Inside
texts and roles ``<`` followed by any number of backslashes and ``|`` gets one backslash more, so
no text can hold a marker, and taking one away gives the text back.

Windows follow from prefix sums of turn tokens, without a pass from turn to turn: a conversation's
token line is ruled into stretches. The room of a conversation is what the budget leaves beside its
system turn and the history; a turn of more than half the room has a window of its own, and a
stretch is the room less the longest of the others, so the turns that start in one stretch fit into
a window. Each window but the first repeats the system turn, then the turns of the last HISTORY
tokens before it as far as the budget goes; only its own assistant turns are under the loss mask. A
window exceeds its budget only if it is a single turn that does. Where a turn fits, but not beside
the system turn, its window does without the system turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, staged, values
from .packing import tokenizer

BUDGET, HISTORY = 2048, 256
#: Turns that are summed up together; a conversation of any length is spread over as many tasks as it has such blocks.
BLOCK = 1024
START, STOP = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _tokens(path: str):
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = tokenizer(path)
        return pa.array([len(encode(x)) for x in values(texts)], pa.int64())

    return count


def _summed(turns: DataFrame, what: dict[str, str]) -> DataFrame:
    """Running sums before each turn, in two levels: within blocks of turn numbers, and over whole blocks."""
    keys = ["conv_id", "block"]
    inner = Window.partitionBy(*keys).orderBy("turn", "role", "tie").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in what])
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), *[F.coalesce(F.sum(f"__{c}").over(over), F.lit(0)).alias(f"b_{c}") for c in what])
    with_inner = turns.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"i_{c}") for c in what])
    joined = with_inner.join(earlier, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    return joined.select(*turns.columns, *[(F.col(f"i_{c}") + F.col(f"b_{c}")).alias(name) for c, name in what.items()])


def format_conversations(rows: DataFrame, path: str, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations in ``rows`` (conv_id, turn, role, text).

    (conv_id, first, formatted, spans, fresh_from, n_turns, n_repeated, tokens): ``first`` orders a
    conversation's windows, ``spans`` are the code-point ranges of ``formatted`` under the loss
    mask, ``fresh_from`` is where turns begin that no window before it has had as its own.

    Turns go by number; equal numbers by role and a hash of the text, a null number comes first. A null role or
    text counts as empty. Rows without a conversation form one conversation, named null. Only a
    conversation's first turn, if its role is ``system``, is repeated, in each window that it fits
    into beside the window's own turns. Repeated rows are turns of their own. ``path`` is the file of the tokenizer that tokens are counted by. Columns beyond the
    four are not read. An empty table gives no rows.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head, body = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("*", F.length(head).alias("head_chars"), F.length(body).alias("body_chars"), F.concat(head, body, F.lit(STOP)).alias("piece"), F.xxhash64("text").alias("tie")).drop("text")
    turns = turns.select("*", _tokens(path)("piece").alias("n"), F.lit(1).cast("long").alias("one"), F.expr(f"turn div {BLOCK}").alias("block"))
    whole = staged(_summed(staged(turns, "turns"), {"n": "before", "one": "number"}), "turns")
    turns = whole.drop("piece")
    system = turns.where("number = 0 and role = 'system'").select(F.col("conv_id").alias("s_conv"), F.col("n").alias("s_n"))
    turns = turns.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").drop("s_conv")
    free = f"greatest({budget} - coalesce(s_n, 0), 0)"
    turns = turns.withColumn("room", F.expr(f"{free} - least({history}, {free} div 4)")).withColumn("long", F.expr("cast(n > room div 2 as long)"))
    longest = turns.where("long = 0").groupBy(F.col("conv_id").alias("l_conv")).agg(F.max("n").alias("l_n"))
    turns = turns.join(longest, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left").drop("l_conv")
    turns = turns.withColumn("stretch", F.expr("greatest(room - coalesce(l_n, 0), 1)"))
    key = ["conv_id", "at", "longs", "long"]
    turns = staged(_summed(turns, {"long": "longs"}).withColumn("at", F.expr("before div stretch")), "turns")
    fresh = turns.select(*key, F.lit(2).alias("kind"), "number", "role", "head_chars", "body_chars", "n")
    windows = turns.groupBy(*key).agg(F.min("before").alias("from"), F.min("number").alias("first"), F.max("s_n").alias("s_n"), F.sum("n").alias("own"))
    later = windows.where("first > 0").withColumn("s_n", F.expr(f"if(own + s_n <= {budget}, s_n, null)"))
    later = later.withColumn("back", F.expr(f"greatest(least({history}, {budget} - own - coalesce(s_n, 0)), 0)"))
    none = [F.lit("").alias("role"), F.lit(0).alias("head_chars"), F.lit(0).alias("body_chars")]
    again = later.where("s_n is not null").select(*key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), *none, F.col("s_n").alias("n"))
    cells = F.array_distinct(F.array(F.expr(f"greatest(`from` - back, 0) div {history}"), F.expr(f"(`from` - 1) div {history}")))
    wanted = later.where("back > 0").select(*[F.col(c).alias(f"w_{c}") for c in key], "from", "back", F.explode(cells).alias("w_cell"))
    past = turns.where("not (number = 0 and role = 'system')").select("conv_id", "before", "number", "n", F.expr(f"before div {history}").alias("cell"))
    recent = past.join(wanted, F.col("conv_id").eqNullSafe(F.col("w_conv_id")) & (F.col("cell") == F.col("w_cell")))
    recent = recent.where("before >= `from` - back and before + n <= `from`").select(*[F.col(f"w_{c}").alias(c) for c in key], F.lit(1).alias("kind"), "number", *none, "n")
    parts = fresh.unionByName(again).unionByName(recent)
    texts = whole.select(F.col("conv_id").alias("p_conv"), F.col("number").alias("p_number"), "piece")
    parts = parts.join(texts, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("number") == F.col("p_number")))
    item = F.struct("kind", "number", "piece", "role", "head_chars", "body_chars", "n")
    made = parts.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    fresh_from = F.aggregate(F.filter("items", lambda x: x.kind < 2), F.lit(0), lambda a, x: a + F.length(x.piece))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def span(a: Column, x: Column) -> Column:
        begin = a.at + x.head_chars
        more = F.array(F.struct(begin.alias("start"), (begin + x.body_chars).alias("end")))
        learn = (x.kind == 2) & (x.role == "assistant")
        return F.struct((a.at + F.length(x.piece)).alias("at"), F.when(learn, F.concat(a.spans, more)).otherwise(a.spans).alias("spans"))

    return made.select(
        "conv_id",
        F.array_min(F.transform(F.filter("items", lambda x: x.kind == 2), lambda x: x.number)).alias("first"),
        F.array_join(F.transform("items", lambda x: x.piece), "").alias("formatted"),
        F.aggregate("items", start, span).getField("spans").alias("spans"),
        fresh_from.alias("fresh_from"),
        F.size(F.filter("items", lambda x: x.kind == 2)).cast("long").alias("n_turns"),
        F.size(F.filter("items", lambda x: x.kind < 2)).cast("long").alias("n_repeated"),
        F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("tokens"),
    )


def turns_of(formatted: str, fresh_from: int = 0) -> list[tuple[str, str]]:
    """(role, text) of each turn from a place on, unescaped."""
    out = []
    for part in formatted[fresh_from:].split(STOP)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        out.append((_role_back(role), unescape(text)))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and window: running digests, one conversation at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, rows = object(), None, []

    def done() -> tuple:
        return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for batch in slices(batches):
        for conv, text, spans, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "fresh_from"))):
            if state is None or conv != now:
                if state is not None:
                    rows.append(done())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text, at):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if state is not None:
        yield pa.record_batch([pa.array([v], k) for v, k in zip(done(), kinds)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted windows alone.

    A conversation's digests run over all of it in order, so its windows stream through one task,
    which holds one window at a time. The conversation without an id is one too. Repeated turns count
    each, empty texts are turns without characters, and without windows there are no rows.
    """
    count = partitions(windows.sparkSession)
    own = windows.select("conv_id", "first", "formatted", "spans", "fresh_from").repartition(count, "conv_id").sortWithinPartitions("conv_id", "first")
    return own.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
