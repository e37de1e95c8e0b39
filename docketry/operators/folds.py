"""Folds over rows in an order, with a state that each row changes: no group is held in memory.

Rows are sorted over range partitions and stored once. A task streams a partition's rows as Arrow batches and carries the
state from batch to batch. First every partition is folded from fresh states; what it then has for a group that
begins in it is final. Where a group fills whole partitions, these are folded again one after another, each from the
state at the end of the one before, those of different groups side by side; a last pass knows every partition's start and gives
the results. One row for each partition comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docketry.sources.tables import written


def folded(df: DataFrame, group: list[str], order: list[Column], inputs: list[Column], step: Callable, start, state_type: str, name: str, result_type: str) -> DataFrame:
    """``df`` with a column ``name``: the results of ``step(state, values) -> (state, results)`` over each group in order.

    ``values`` is a list for each of ``inputs``, for some consecutive rows of a group; ``results`` has an item for each row. ``start``
    is a group's first state, of ``state_type`` (a number, a text or an array). A null in a column of ``group`` is a value; no columns are one group.
    Give a total order. Rows stay as they are, in any order.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("-")) for g in group]
    key = reduce(lambda a, b: F.concat(a, F.lit("\u0001"), b), parts) if parts else F.lit("")
    given = [f"_in{i}" for i in range(len(inputs))]
    keyed = df.select("*", key.alias("_group"), *(c.alias(n) for c, n in zip(inputs, given)))
    sort = [F.col("_group"), *order]
    dealt = written(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    slim = dealt.select("_part", "_at", "_group", *given)
    ends = {r.part: r for r in _ends(slim, given, step, start, state_type, {})}
    numbers = sorted(ends)
    before = dict(zip(numbers[1:], numbers))
    goes_on = {p for p in numbers if p in before and ends[p].first == ends[before[p]].last}
    waiting = {p for p in goes_on if ends[p].first == ends[p].last}  # whole partitions inside a group
    while waiting:
        ready = sorted(p for p in waiting if before[p] not in waiting)
        starts = {p: ends[before[p]].state for p in ready}
        ends |= {r.part: r for r in _ends(slim.where(F.col("_part").isin(ready)), given, step, start, state_type, starts)}
        waiting -= set(ready)
    starts = {p: ends[before[p]].state for p in goes_on}
    kept = [f.name for f in df.schema]
    kind = T.DataType.fromDDL(result_type)
    arrow_kind = to_arrow_type(kind)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results, _ in _walk(batches, given, step, start, starts):
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(results, arrow_kind)], [*kept, name])

    return _in_order(dealt).mapInArrow(told, T.StructType([*df.schema, T.StructField(name, kind)]))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("_part").sortWithinPartitions("_part", "_at")


def _walk(batches: Iterator[pa.RecordBatch], given: list[str], step: Callable, start, starts: dict) -> Iterator[tuple]:
    """(batch, results, (part, first group, last group, state) of each partition as far as it was read)."""
    part = first = group = state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, groups = batch.column("_part").to_numpy(), batch.column("_group")
        code = groups.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (parts[1:] != parts[:-1])]))
        results, said = [], []
        for a, b in zip(runs, [*runs[1:], batch.num_rows]):
            own = groups[int(a)].as_py()
            if part != parts[a]:
                part, first, group, state = int(parts[a]), own, own, starts.get(int(parts[a]), start)
            elif group != own:
                group, state = own, start
            state, more = step(state, [batch.column(c).slice(a, b - a).to_pylist() for c in given])
            results += more
            said.append((part, first, group, state))
        yield batch, results, said


def _ends(slim: DataFrame, given: list[str], step: Callable, start, state_type: str, starts: dict) -> list:
    """part, first, last and state of each partition: the groups that it begins and ends with, and the state at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {}
        for _, _, said in _walk(batches, given, step, start, starts):
            last |= {s[0]: s for s in said}
        if last:
            rows = list(last.values())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows])], ["part", "first", "last", "state"])

    return _in_order(slim).mapInArrow(run, f"part int, first string, last string, state {state_type}").collect()
