"""Searches of sets within blocks: how members are laid out and visits dealt.

A similarity join keeps its members in blocks of bounded size, each with an
index of its own.  A member asks in its own block and visits the later ones that
may hold a partner; a block whose visits are much work is dealt to several
tasks, each of which reads its members and then a share of those who ask.
Pairs of a group never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

#: Rows of a task's share of a block: the members, in the same order in all
#: shares, some of which ask there; then the guests.
MEMBER, ASKING, GUEST = 0, 1, 2


def in_stretches(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``rows`` with the ``block`` they belong to: equal stretches, by the sum
    of ``room`` (long, their last column), of the rows in ``order``.

    Every task of a global sort adds up the room of its rows; with the sums of
    the tasks before, a row for each of them, blocks are stretches of the
    whole, however many tasks there are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                ends = before + np.cumsum(batch.column(batch.num_columns - 1).to_numpy())
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), task)), pa.array(ends)], [*batch.schema.names, "task", "end"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, f"{kinds}, task long, end long"), "stretches")
    tasks = rows.groupBy("task").agg(F.max("end").alias("room"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("room").over(earlier), F.lit(0)).alias("before"))
    block = F.floor((F.col("before") + F.col("end") - 1) / limit).alias("block")
    return rows.join(F.broadcast(tasks), "task").select("*", block).drop("task", "end", "room", "before")


def dealt(members: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """``block, share, kind`` and the columns of ``members`` (``class, block``
    and others), as tasks read them.

    ``asked`` has ``class, home, block, work`` for every visit, that to the own
    block included; ``limit`` is the work of a share, about.
    """
    tasks = asked.groupBy("block").agg(F.ceil(F.sum("work") / limit).alias("tasks"))
    share = F.pmod(F.xxhash64("class"), F.col("tasks"))
    shares = tasks.select("block", "tasks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("share"))
    own = members.join(shares, "block").withColumn("kind", F.when(share == F.col("share"), ASKING).otherwise(MEMBER))
    guests = members.drop("block").join(asked.where("home < block").select("class", "block").join(tasks, "block"), "class")
    guests = guests.withColumns({"share": share, "kind": F.lit(GUEST)})
    columns = ["block", "share", "kind", *[c for c in members.columns if c != "block"]]
    # As many tasks as that in any case: the work is far more than the bytes tell.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.select(columns).unionByName(guests.select(columns)).repartition(parts, "block", "share")
    return rows.sortWithinPartitions("block", "share", F.col("kind") == GUEST, "class")


@dataclass
class Unit:
    """A share of a block, as far as it has been read."""

    key: tuple[int, int]
    members: list[tuple] = field(default_factory=list)
    asking: list[int] = field(default_factory=list)
    index: Any = None


def searches(batches: Iterator[pa.RecordBatch], rows_of: Callable, index_of: Callable) -> Iterator[tuple[Unit, tuple, int]]:
    """Who asks where: ``(unit, row, after)``, the row being looked for among
    the unit's members past ``after``.

    ``rows_of`` gives the rows of a batch without their first three columns,
    ``index_of`` the index of a unit's members, made once they are complete.
    """
    unit = None

    def begin() -> Iterator[tuple[Unit, tuple, int]]:
        if unit is not None and unit.index is None:
            unit.index = index_of(unit.members)
            for k in unit.asking:
                yield unit, unit.members[k], k

    for batch in batches:
        blocks, shares, kinds = (batch.column(k).to_pylist() for k in range(3))
        for block, share, kind, row in zip(blocks, shares, kinds, rows_of(batch), strict=True):
            if unit is None or unit.key != (block, share):
                yield from begin()
                unit = Unit((block, share))
            if kind == GUEST:
                yield from begin()
                yield unit, row, -1
            else:
                if kind == ASKING:
                    unit.asking.append(len(unit.members))
                unit.members.append(row)
    yield from begin()


class Forest:
    """Which names are linked so far, by union and find."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart until now."""
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


class Lists:
    """The inverted lists of a block's sets (sorted arrays)."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        members = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.members = flat[order], members[order]
        begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        self.values, self.bounds, self.size = flat[begins], np.append(begins, len(flat)), len(sets)

    def of(self, values: np.ndarray) -> np.ndarray:
        """The numbers of the lists of the given values."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return at[self.values[at] == values]
