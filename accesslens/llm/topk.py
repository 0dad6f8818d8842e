"""Exact top-k inner products by MaxScore over blocks of vectors.

A vector is a document whose terms are its dimensions; a component is its
weight.  Candidates are stored in shards of at most ``SHARD`` rows, queries in
blocks of at most ``BLOCK``.  A task takes some of the shards and at most about
``GROUP`` queries, and every block in it meets every shard; nothing is copied
for that, both are read where they lie.  What a block has found in one shard is
its threshold in the next; a task gives at most k rows a query, which a window
merges.

Within a shard, each term has a bound for a query: the most that query weight
times a component can be in this shard.  Terms are taken by falling range.
The first are *essential*: their postings (the shard's column of that term)
are traversed for all candidates and partial scores summed, until the bounds
of the other, non-essential terms show that most candidates cannot reach the
k-th best score.  Only what stays competitive is then probed on the rest, term
group by term group, and dropped as soon as its bound falls short.  Scores and
bounds are whole numbers, so the result is exact, ties included; they are
summed as floats where all of them are small enough for that to be exact too.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; only vectors of equal length are compared; a row is
never compared with rows of its own id, so repeated rows with other ids tie
and go by the smaller id; a null id takes no part; other columns are ignored.
Components are rounded down to ``floor(SCALE * x)`` and must stay below 2**26
in size for exact 64-bit sums (up to 2**11 components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

SCALE = 256
SHARD, BLOCK = 4096, 1024
#: Queries that a task holds while its shards pass, about.
GROUP = 4096
#: Queries of a block whose scores in a shard are held at once.
STRIPE = 256
#: Terms summed before bounds are looked at again.
STEP = 8
#: Candidates are probed one by one once they are one in so many.
FEW = 256
#: Sums below these are exact in the type, and so are their differences.
EXACT = ((np.float32, 2.0**23), (np.float64, 2.0**52))
#: The threshold of a query that has no k candidates yet.
LOWEST = np.iinfo(np.int64).min
HITS = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, cells, length``: whole-number vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite).select("vec_id", cells.alias("cells"), F.size("v").alias("length"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows as blocks ``number, length, ids, cells`` (binary) of at most
    ``size`` rows, cut where they lie, so that none is moved by a key."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(length: int) -> pa.RecordBatch:
            parts = held.pop(length)
            ids, cells = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for at in range(0, len(ids), size):
                yield pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "ids": [ids[at : at + size].tobytes()], "cells": [cells[at : at + size].tobytes()]})

        for batch in batches:
            ids, lengths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(lengths)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                cells = flat[(ends[rows] - length)[:, None] + np.arange(length)]
                held.setdefault(length, []).append((ids[rows], cells))
                if sum(len(p[0]) for p in held[length]) >= size:
                    yield from block(length)
        for length in list(held):
            yield from block(length)

    cut_rows = rows.select("vec_id", "cells", "length").mapInArrow(cut, "length int, ids binary, cells binary")
    return cut_rows.select(F.monotonically_increasing_id().alias("number"), "*")


class Shard:
    """Candidates by rising id, with the range and the postings of each term."""

    def __init__(self, docs: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(docs[order].T)
        self.low, self.high = docs.min(axis=0), docs.max(axis=0)


class Best:
    """The k best that each query of a block has found so far: ``row`` (of the
    block), ``ids`` and ``scores``, by row and rank."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.row = self.ids = self.scores = np.zeros(0, np.int64)
        # Score and id of the k-th best.
        self.least, self.last = np.full(len(queries), LOWEST), np.zeros(len(queries), np.int64)

    def search(self, shard: Shard) -> None:
        """Take in what a shard has that is better."""
        found = [(self.row, self.ids, self.scores)]
        for at in range(0, len(self.queries), STRIPE):
            row, place, scores = self.reaching(shard, slice(at, at + STRIPE))
            row, ids = row + at, shard.ids[place]
            better = (scores > self.least[row]) | (ids < self.last[row])
            found.append((row[better], ids[better], scores[better]))
        row, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, ~scores, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.row, self.ids, self.scores = row[order], ids[order], scores[order]
        last = rank == self.k - 1
        self.least[self.row[last]], self.last[self.row[last]] = self.scores[last], self.ids[last]

    def reaching(self, shard: Shard, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (of ``part``), place in the shard and score of what reaches the
        row's k-th best so far, or what k candidates of the shard reach."""
        queries, query_ids, least = self.queries[part], self.query_ids[part], self.least[part]
        largest = np.maximum(np.abs(shard.low.astype(float)), np.abs(shard.high.astype(float)))
        limit = float(np.abs(queries.astype(float)).max(axis=0) @ largest)
        kind = next((kind for kind, exact in EXACT if limit < exact), np.int64)
        ends = queries * shard.low, queries * shard.high
        bound = np.maximum(*ends)
        terms = np.argsort(-(bound - np.minimum(*ends)).sum(axis=0, dtype=float), kind="stable")
        rest = np.zeros((len(bound), len(terms) + 1), np.int64)
        rest[:, :-1] = np.cumsum(bound[:, terms[::-1]], axis=1)[:, ::-1]
        queries, postings, rest = queries[:, terms].astype(kind), shard.postings[terms].astype(kind), rest.astype(kind)
        # A first threshold from a few candidates scored in full.
        some = slice(None, None, max(1, len(shard.ids) // (8 * self.k)))
        exact = (queries @ postings[:, some]).astype(np.int64)
        exact[shard.ids[some] == query_ids[:, None]] = LOWEST
        if exact.shape[1] >= self.k:
            least = np.maximum(least, np.partition(exact, exact.shape[1] - self.k, axis=1)[:, exact.shape[1] - self.k])
        least = least.astype(kind)
        # Essential for most queries: what else there is does not reach the threshold.
        short = (rest < least[:, None]).mean(axis=0) >= 0.5
        at = int(short.argmax()) if short.any() else len(terms)
        partial = queries[:, :at] @ postings[:at]
        while True:
            reach = partial + rest[:, at, None] >= least[:, None] if kind is np.int64 else partial >= (least - rest[:, at])[:, None]
            if at == len(terms) or np.count_nonzero(reach) * FEW <= reach.size:
                break
            partial += queries[:, at : at + STEP] @ postings[at : at + STEP]
            at = min(at + STEP, len(terms))
        row, place = np.divmod(np.flatnonzero(reach), len(shard.ids))
        others = query_ids[row] != shard.ids[place]
        row, place = row[others], place[others]
        scores = partial[row, place]
        for at in range(at, len(terms), STEP):
            group = slice(at, at + STEP)
            scores += (queries[row, group] * postings[group, place].T).sum(axis=1)
            keep = scores + rest[row, min(at + STEP, len(terms))] >= least[row]
            row, place, scores = row[keep], place[keep], scores[keep]
        return row, place, scores.astype(np.int64)


def max_score(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best of a shard for every query: its id, their ids and scores."""
    best = Best(queries, query_ids, k)
    best.search(Shard(docs, doc_ids))
    for row in np.unique(best.row).tolist():
        yield int(query_ids[row]), best.ids[best.row == row], best.scores[best.row == row]


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other rows for every
    row that ``is_query`` (on ``vec_id``) holds for."""
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    shards = staged(blocks(rows, SHARD), "shards")
    wanted = rows.where(is_query)
    tasks = max(1, wanted.count() // GROUP)
    asked = staged(blocks(wanted.repartition(tasks), BLOCK), "queries")
    # Every block meets every shard: the stated query set against all rows, in
    # blocks.  Neither side is shuffled by a key or sent through the driver: a
    # task reads a part of each, and their number grows with both.
    stored = shards.select("number", "length", F.col("ids").alias("doc_ids"), F.col("cells").alias("doc_cells"))
    blocks_asked = asked.repartition(tasks).select(F.col("number").alias("block"), "length", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"))
    met = stored.join(blocks_asked.hint("shuffle_replicate_nl"), "length")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, best = None, None, {}
        for batch in batches:
            numbers, asking, lengths = (batch.column(i).to_pylist() for i in range(3))
            read = lambda i, j, batch=batch: np.frombuffer(batch.column(i)[j].as_buffer(), np.int64)
            for j, (number, block, length) in enumerate(zip(numbers, asking, lengths, strict=True)):
                if number != held:
                    shard, held = Shard(read(4, j).reshape(-1, length), read(3, j)), number
                if block not in best:
                    best[block] = Best(read(6, j).reshape(-1, length).copy(), read(5, j).copy(), k)
                best[block].search(shard)
        for found in best.values():
            yield pa.RecordBatch.from_pydict({"query_id": found.query_ids[found.row], "vec_id": found.ids, "score": found.scores})

    hits = staged(met.select("number", "block", "length", "doc_ids", "doc_cells", "query_ids", "query_cells").mapInArrow(search, HITS), "hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
