"""Finite-state machines over ordered rows of any length: states as a prefix scan of transition maps.

A row's state depends on all rows before it. Blocks of rows make that a matter of many tasks: a block
is a map from the state before it to the state behind it, whatever that state is, so all blocks are
mapped at once; maps are composed by stretches of blocks; states run over the stretches, then over
each stretch's blocks, and at last over each block's rows. Nothing is gathered but a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, and blocks of a stretch.
BLOCK, STRETCH = 1024, 1024


@dataclass(frozen=True)
class Machine:
    """States that follow each other by codes: ``step(state, code)``, from ``start``.

    States that can be reached are numbered, the start is 0. ``marks(codes, states)`` says what each row
    of a block is, given the states before each row; it sees the ``ahead`` rows behind the block too.
    """

    start: object
    step: Callable[[object, int], object]
    codes: int
    marks: Callable[[list[int], list[object]], list[int]]
    ahead: int = 0
    states: list = field(default_factory=list)
    table: list = field(default_factory=list)

    def built(self) -> Machine:
        """The machine with its states and, for each code, where each state goes."""
        if not self.states:
            number = {self.start: 0}
            self.states.append(self.start)
            rows: list[list[int]] = []
            for state in self.states:
                rows.append([])
                for code in range(self.codes):
                    after = self.step(state, code)
                    if after not in number:
                        number[after] = len(self.states)
                        self.states.append(after)
                    rows[-1].append(number[after])
            self.table.append(np.array(rows, np.uint16).T.copy())
        return self

    def mapped(self, codes: np.ndarray) -> np.ndarray:
        """Where each state is after the codes. What a code does to all states is one look-up."""
        table, now = self.table[0], np.arange(len(self.states), dtype=np.uint16)
        for code in codes.tolist():
            now = table[code][now]
        return now

    def walked(self, codes: list[int], state: int) -> list[int]:
        """The states before each code, from one."""
        table, out = self.table[0], []
        for code in codes:
            out.append(state)
            state = int(table[code][state])
        return out


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Sorted rows as one table for each value of ``names``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and keys[at] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield now, pa.Table.from_batches(held)


def _field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


def _entries(long: DataFrame, key: str, idx: str, code: str, machine: Machine) -> DataFrame:
    """(key, block, state) before each block of the rows of ``long``."""
    key_field = _field(long, key)
    blocks = T.StructType([key_field, T.StructField("block", T.LongType()), T.StructField("map", T.BinaryType())])
    states = T.StructType([key_field, T.StructField("block", T.LongType()), T.StructField("state", T.IntegerType())])

    def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.built()
        for now, rows in _runs(batches, [key, "block"]):
            done = own.mapped(rows.column(code).to_numpy())
            yield pa.record_batch([rows.column(key).combine_chunks().slice(0, 1), pa.array([now[1]], pa.int64()), pa.array([done.tobytes()], pa.binary())], [key, "block", "map"])

    def of_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, rows in _runs(batches, [key, "stretch"]):
            done = None
            for one in rows.column("map").to_pylist():
                next_ = np.frombuffer(one, np.uint16)
                done = next_ if done is None else next_[done]
            yield pa.record_batch([rows.column(key).combine_chunks().slice(0, 1), pa.array([now[1]], pa.int64()), pa.array([done.tobytes()], pa.binary())], [key, "block", "map"])

    def running(first: str | None):
        """Rows sorted by key and block: the state before each, from the start or from what the row of ``first`` says."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = None, 0
            names = [key] if first is None else [key, first]
            for batch in batches:
                maps, blocks_ = batch.column("map").to_pylist(), batch.column("block").to_pylist()
                keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
                given = batch.column("state").to_pylist() if first is not None else None
                keep, out = [], []
                for i, one in enumerate(maps):
                    if keys[i] != now:
                        now, state = keys[i], 0
                    if one is None:
                        state = given[i]
                        continue
                    keep.append(i)
                    out.append(state)
                    state = int(np.frombuffer(one, np.uint16)[state])
                at = pa.array(keep, pa.int64())
                yield pa.record_batch([batch.column(key).take(at), pa.array([blocks_[i] for i in keep], pa.int64()), pa.array(out, pa.int32())], [key, "block", "state"])

        return task

    place = F.floor(F.col(idx) / BLOCK).cast("long")
    codes = long.select(key, place.alias("block"), idx, code).repartition(key, "block").sortWithinPartitions(key, "block", idx)
    maps = codes.mapInArrow(of_block, blocks)
    stretched = maps.withColumn("stretch", F.floor(F.col("block") / STRETCH).cast("long"))
    whole = stretched.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "block").mapInArrow(of_stretch, blocks)
    before = whole.repartition(key).sortWithinPartitions(key, "block").mapInArrow(running(None), states)
    heads = before.select(key, F.col("block").alias("stretch"), F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("map"), "state")
    both = heads.unionByName(stretched.withColumn("state", F.lit(None).cast("int")))
    return both.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "block").mapInArrow(running("stretch"), states)


def marked(rows: DataFrame, key: str, idx: str, code: str, machine: Machine, long: DataFrame) -> DataFrame:
    """``rows`` with ``mark``, what the machine says of each row of a key in order of ``idx`` (from 0, without gaps).

    ``long`` has the rows, or their key, idx and code alone, of keys with more than BLOCK rows; only
    those need what came before a block. A block and the ``ahead`` rows behind it are in one task.
    """
    place = F.floor(F.col(idx) / BLOCK).cast("long")
    names, fields = rows.columns, list(rows.schema.fields)
    late = (F.col(idx) % BLOCK < machine.ahead) & (F.col("__block") > 0)
    dealt = rows.withColumn("__block", place)
    if machine.ahead:
        dealt = dealt.withColumn("__block", F.explode(F.when(late, F.array("__block", F.col("__block") - 1)).otherwise(F.array("__block"))))
    entries = _entries(long, key, idx, code, machine).where("state <> 0").withColumnRenamed("block", "__block").withColumnRenamed("state", "__state")
    whole = dealt.withColumn("__state", F.lit(None).cast("int")).unionByName(entries, allowMissingColumns=True)
    order = whole.repartition(key, "__block").sortWithinPartitions(F.col(key), F.col("__block"), F.col("__state").isNull(), F.col(idx))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.built()
        for (_, block), table in _runs(batches, [key, "__block"]):
            state = table.column("__state")[0].as_py()
            if state is not None:
                table = table.slice(1)
            if not len(table):
                continue
            codes = table.column(code).to_pylist()
            said = own.marks(codes, [own.states[s] for s in own.walked(codes, state or 0)])
            table = table.select(names).append_column("mark", pa.array(said, pa.int32()))
            yield from table.filter(pc.less(table.column(idx), (block + 1) * BLOCK)).to_batches()

    return order.mapInArrow(task, T.StructType([*fields, T.StructField("mark", T.IntegerType())]))
