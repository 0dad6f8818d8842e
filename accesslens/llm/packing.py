"""Packing of documents into fixed-length training sequences.

Lengths are whole numbers up to the capacity, so a corpus is, for packing, a
count for each length.  The plan is made on these counts, of which there are
never more than ``capacity``, whatever the corpus:

* *Large* pieces, above a third of the capacity, fit at most twice in a
  sequence.  They are paired greedily: the longest still unpaired with the
  longest that fits beside it.
* Smaller pieces go, longest first, into the smallest remaining gap that takes
  them (best fit); where none does, a new sequence begins.

Equal lengths are placed many at a time: a step of the plan says that so many
pieces of one length go, so many each, into a range of sequences at a position.
A piece finds its place from its rank among the pieces of its length.  Ranks
are counted inside a task while tokenising and shifted by the counts of the
tasks before, so that no length, however frequent, is gathered anywhere.

Defined cases: a null text is an empty one, which is its end token alone; a
document without tokens (no end token asked for) has no piece; a null id is
packed as it is; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.encoder import encoder
from accesslens.llm.staging import staged
from accesslens.llm.words import slices, text_of

PIECES = "doc_id long, piece int, start long, length long, task long, rank long, ids binary"


@dataclass
class Plan:
    """Steps sorted by (length, first rank): pieces of ``length`` from rank
    ``first`` on go ``each`` into a sequence, sequences from ``sequence`` on,
    the first of each at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        span = np.int64(1) << 44
        step = np.searchsorted(self.length * span + self.first, lengths * span + ranks, "right") - 1
        nth = ranks - self.first[step]
        return self.sequence[step] + nth // self.each[step], self.offset[step] + nth % self.each[step] * lengths


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """The placement of ``counts[length]`` pieces of every length."""
    steps: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    total = 0

    def put(length: int, sequence: int, number: int, each: int, offset: int) -> None:
        steps.append((length, used[length], sequence, each, offset))
        used[length] += number

    def free(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((sequence, number))

    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        n = left[longest]
        k = bisect_left(large, capacity - longest + 1) - 1
        other = large[k] if k >= 0 else None
        if other is None:
            number, rest = n, capacity - longest
        elif other == longest:
            number, rest = n // 2, capacity - 2 * longest
            if not number:  # one of this length is left: its partner is the next shorter
                other = large[k - 1] if k else None
                number, rest = 1, capacity - longest - (other or 0)
        else:
            number, rest = min(n, left[other]), capacity - longest - other
        if other == longest:
            put(longest, total, 2 * number, 2, 0)
            left[longest] -= 2 * number
        else:
            put(longest, total, number, 1, 0)
            left[longest] -= number
            if other is not None:
                put(other, total, number, 1, longest)
                left[other] -= number
        free(rest, total, number)
        total += number
        large = [length for length in large if left[length]]
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                sequence, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                each = capacity // length
                gap, sequence, number = capacity, total, max(1, left[length] // each)
                total += number
            each = gap // length
            full = min(number, left[length] // each)
            if full:
                put(length, sequence, full * each, each, capacity - gap)
                free(gap - each * length, sequence, full)
            rest = left[length] - full * each
            if rest < each and full < number and rest:
                put(length, sequence + full, rest, rest, capacity - gap)
                free(gap - rest * length, sequence + full, 1)
                full, rest = full + 1, 0
            free(gap, sequence + full, number - full)
            left[length] = rest
    columns = np.array(sorted(steps), np.int64).reshape(-1, 5).T
    return Plan(*columns, total)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids (16-bit little-endian where
    the vocabulary allows, else 32), with the rank among the task's pieces of
    the same length."""
    kind = "<u2" if max(encoder(path).size, end_id or 0) <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        width = int(kind[-1])
        for batch in slices(batches):
            ids, counts = own.encode(text_of(batch.column(1)))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            data = memoryview(ids.astype(kind).tobytes())
            parts = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), parts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = number * capacity
            lengths = np.minimum(capacity, counts[owner] - starts)
            order = np.argsort(lengths, kind="stable")
            runs = lengths[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(runs, runs) + seen[runs]
            seen += np.bincount(lengths, minlength=capacity + 1)
            begins = ((np.cumsum(counts) - counts)[owner] + starts) * width
            blobs = [bytes(data[a : a + n]) for a, n in zip(begins.tolist(), (lengths * width).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(starts), pa.array(lengths), pa.array(np.full(len(owner), task)), pa.array(rank), pa.array(blobs, pa.binary())],
                ["doc_id", "piece", "start", "length", "task", "rank", "ids"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def wide(ids: Column, length: Column) -> Column:
    """``ids`` as little-endian 32-bit numbers: two zero bytes after each pair."""
    return F.when(F.octet_length(ids) == 4 * length, ids).otherwise(F.unhex(F.regexp_replace(F.hex(ids), "(.{4})", "$10000")))


def packed(docs: DataFrame, path: str, capacity: int, end_id: int | None, *, derive: dict[str, Column] | None = None, **columns: str) -> DataFrame:
    """``doc_id, piece, start, length, sequence_id, offset`` and ``ids`` of
    every piece; ``derive`` replaces ``ids`` by columns computed from a row
    before it is moved."""
    cut = staged(pieces(docs, path, capacity, end_id, **columns), "pieces")
    counts = staged(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = cut.sparkSession.sparkContext.broadcast(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("task").alias("in_task"), F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = derive or {"ids": F.col("ids")}
    rows = cut.select("doc_id", "piece", "start", "length", "task", "rank", *(c.alias(name) for name, c in kept.items()))
    ranked = rows.join(bases, (F.col("task") == F.col("in_task")) & (F.col("length") == F.col("of_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("base") + F.col("rank")).alias("rank"), *kept)
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in ranked.schema if field.name != "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy()) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            rest = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence), pa.array(offset)], [*rest.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_digests(docs: DataFrame, path: str, capacity: int, end_id: int | None, **columns: str) -> DataFrame:
    """As ``packed``, with the crc32 of each piece's ids instead of them."""
    return packed(docs, path, capacity, end_id, derive={"ids_crc32": F.crc32(wide(F.col("ids"), F.col("length")))}, **columns)
