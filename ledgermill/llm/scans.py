"""Scans over a sorted table: running sums and numbers that go on from one partition to the next.

``in_order`` sorts a table over range partitions and checkpoints it, so that its partitions, and their order, stay.  A scan
then reads them twice: once for a small summary of each partition, from which the driver works out what each partition
begins with (one entry a partition), and once to finish the rows.  No key has to fit into one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import shared_dir, stash
from ledgermill.llm.vectors import SAFE

#: Keys asked for by more rows than this, and by more than the HOT_KEYS-th part of all rows, are looked up by broadcast.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def in_order(df: DataFrame, keys: list[Column | str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of df, sorted by ``keys`` over range partitions, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keep).checkpoint()


def summaries(df: DataFrame, of: Callable[[Iterator[pd.DataFrame], int], object]) -> list[tuple[int, object]]:
    """What ``of`` returns of each partition that has rows, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        found = of((b for b in batches if len(b)), part)
        if found is not None:
            yield pd.DataFrame({"part": [part], "found": [pickle.dumps(found)]})

    rows = df.mapInPandas(run, "part int, found binary").collect()
    return sorted((r["part"], pickle.loads(r["found"])) for r in rows)


def finish(df: DataFrame, carries: dict[int, object], of: Callable[[Iterator[pd.DataFrame], object], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``of`` makes of each partition and its carry (None if it has none)."""
    shared = df.sparkSession.sparkContext.broadcast(carries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from of((b for b in batches if len(b)), shared.value.get(TaskContext.get().partitionId()))

    return df.mapInPandas(run, schema)


def running(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_before``: the sum of each column over all rows before, of a table in order."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c}_before long" for c in columns])

    def total(batches, _):
        sums = None
        for b in batches:
            part = [int(b[c].sum()) for c in columns]
            sums = part if sums is None else [x + y for x, y in zip(sums, part)]
        return sums

    def add(batches, carry):
        carry = list(carry or [0] * len(columns))
        for b in batches:
            out = b.copy()
            for i, c in enumerate(columns):
                ends = b[c].cumsum()
                out[f"{c}_before"] = ends - b[c] + carry[i]
                carry[i] += int(ends.iloc[-1])
            yield out

    carries, at = {}, [0] * len(columns)
    for part, sums in summaries(df, total):
        carries[part] = at
        at = [x + y for x, y in zip(at, sums)]
        if max(at) >= SAFE:
            raise OverflowError("a sum over all rows does not fit in 64 bits")
    return finish(df, carries, add, schema)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with ``right``, whose keys are unique; ``weight`` is how many rows of ``left`` ask for one, in all ``total`` at most.

    Keys that would be a hot group of the shuffle (HOT_KEYS at most) meet the rows of ``left`` where they lie.
    """
    hot = right.where(F.col(weight) > max(HOT_ROWS, total // HOT_KEYS))
    if hot.isEmpty():
        return left.join(right.drop(weight), keys)
    hot = stash(hot.drop(weight), "hot-keys")
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.drop(weight), keys))
