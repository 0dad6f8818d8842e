"""Jaccard join of documents on word n-grams by T-occurrence search.

A document is its set of distinct ``SHINGLE``-word shingles (A-Z lower-cased);
equal sets form a class and count once.  Two classes of n and m shingles link
when their overlap is at least T(n, m) = SIMILAR / (100 + SIMILAR) * (n + m):
the T-occurrence problem on the inverted lists of one's shingles.

1. *Only what can link goes on.*  A class needs ceil(0.8 n) shingles that some
   other class has too.  Of its shingles in hash order the first
   n - ceil(0.8 n) + l must then hold l shared ones, so only these, as 32-bit
   marks, are dealt out and counted; l is a tenth of the smallest partner's
   size.  A slice of texts counts what several of its classes hold itself and
   hands on one mark of it, so a shingle of every document is as cheap as a
   rare one, and copies of a text count as one.
2. Document frequencies, exact among the classes left, order their shingles;
   those of a single class cannot overlap and only count in n.
3. *Blocks.*  Classes are laid out by the least hash of their shared shingles,
   which puts copies side by side, and cut into blocks of bounded size with
   inverted lists of their own.  A class visits the later blocks that hold one
   of its rarest shingles (all but the T - 1 most frequent), and its own.
4. *DivideSkip.*  In a block, a visitor's longest lists are set aside; the
   others are merged by a heap of cursors that skips what cannot reach the
   remaining threshold, and candidates are looked up in the long lists by
   binary search.  Overlaps are exact, so nothing is verified afterwards.

A visit gives one row with its number of links, and a block one row for each
of its classes; of the links themselves only a spanning forest is written.
Pairs of a group never become rows: a family of f classes costs f * f / (2 *
BLOCK_CLASSES) visits at most, and a block with much work is dealt to several
tasks.  What a visit costs grows with the lists it merges, so that of a whole
family of near copies grows with the square of f, as any exact search does.

Defined cases: fewer words than ``SHINGLE`` make one shingle of the whole
sequence; a null or empty text, or one without words, has no shingles and is
linked with nothing; a null id is linked with nothing and has a null component
and no links; rows that repeat an id count as one document for each different
set, and each gets the component of its own text.  Very long texts are handled
alone, a block holds at least one class however large.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.blocks import Forest, Lists, dealt, in_stretches, searches
from accesslens.llm.components import connected_components
from accesslens.llm.staging import small_batches, staged
from accesslens.llm.words import gather, hashes, slices, split_words, text_of

SHINGLE = 5
SIMILAR = 80  # per cent
#: A block's size: classes, and shingles of all of them.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 500_000
#: Ids up to which a lookup is broadcast (about 10 MB); beyond it is shuffled.
BROADCAST_ROWS = 400_000
#: Places of lists that one task may touch, about; a block with more work is
#: dealt to several tasks.
WORK = 1_000_000
#: Weight of the list length in the number of lists set aside (DivideSkip);
#: small, because a binary search here costs far less than a step of the heap.
MU = 0.001
PRIME = np.uint64(0xC2B2AE3D27D4EB4F)


def least_overlap(n: int) -> int:
    """The shingles that a set of n must share with any linked set."""
    return -(-SIMILAR * n // 100)


def needed(n, m):
    """The overlap from which sets of n and m shingles are linked."""
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def extra(n):
    """How many shared ones are looked for among a set's first shingles."""
    return np.maximum(1, n // 10)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, rising, end to end, and where
    each text's begin (one more entry than texts)."""
    words = split_words(text_of(column), lower=True)
    each = hashes(words.uniques)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(each) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * PRIME + each[k : k + len(rolled)]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    parts, sizes = [], np.zeros(len(words.first), np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            parts.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            parts.append(np.array([xxhash.xxh3_64_intdigest(each[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            continue
        sizes[i + 1] = len(parts[-1])
    return (np.concatenate(parts) if parts else rolled[:0]), np.cumsum(sizes)


def _classes(flat: np.ndarray, starts: np.ndarray) -> list[int | None]:
    """A 64-bit name of each set; None for an empty one."""
    ends = zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    return [None if a == b else xxhash.xxh3_64_intdigest(flat[a:b].tobytes(), seed=b - a) - (1 << 63) for a, b in ends]


def _batch(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: set size and class."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1))
            sizes, classes = pa.array(np.diff(starts)), pa.array(_classes(flat, starts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, classes], ["doc_id", "n_shingles", "class"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, class long")


def marks(texts: DataFrame, parts: int) -> DataFrame:
    """Marks of the first shingles of the classes of ``doc_id, text``, dealt to
    ``parts``: rows of many marks and their classes.

    What two classes of a slice of texts have is shared: such classes go into
    a row without marks, and one mark without a class tells the other slices.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1))
            named = {c: i for i, c in reversed(list(enumerate(_classes(flat, starts)))) if c is not None}
            if not named:
                continue
            classes, rows = np.array(list(named), np.int64), np.array(list(named.values()))
            sizes = np.diff(starts)[rows]
            first = np.minimum(sizes, sizes - -(-SIMILAR * sizes // 100) + extra(sizes))
            chosen = flat[gather(starts[:-1][rows], first)]
            owners = np.repeat(classes, first)
            order = np.argsort(chosen, kind="stable")
            chosen, owners = chosen[order], owners[order]
            begins = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
            runs = np.diff(np.append(begins, len(chosen)))
            hashed, many = chosen[begins], runs > 1
            owner, twice = np.where(many, np.int64(0), owners[begins]), np.repeat(many, runs)
            part = (hashed % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            hashed, owner, many, part = hashed[order], owner[order], many[order], part[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            short = (hashed >> np.uint64(32)).astype("<u4")
            yield _batch(
                part=([int(part[a]) for a, _ in spans] + [int(classes[0]) % parts], pa.int64()),
                marks=([short[a:b].tobytes() for a, b in spans] + [None], pa.binary()),
                many=([np.packbits(many[a:b]).tobytes() for a, b in spans] + [None], pa.binary()),
                owners=([owner[a:b].tobytes() for a, b in spans] + [owners[twice].tobytes()], pa.binary()),
            )

    return texts.mapInArrow(mark, "part long, marks binary, many binary, owners binary")


def shared_counts(dealt: DataFrame, parts: int) -> DataFrame:
    """``class, shared``: how many first shingles of a class others have too.

    Of a class with copies in several slices, what a slice has found itself is
    taken from the slice that found most: a mark that one of them has not found
    comes from there and is counted here.  Counts may be too high, which
    lets a class pass that cannot link; they are never too low.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list, list]] = {}

        def counted(owner: np.ndarray, here: bool) -> pa.RecordBatch:
            names, times = np.unique(owner, return_counts=True)
            none = np.zeros(len(names), np.int64)
            return _batch(**{"class": (names, pa.int64()), "dealt": (none if here else times, pa.int64()), "here": (times if here else none, pa.int64())})

        for batch in batches:
            for part, short, many, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner = np.frombuffer(owners, np.int64)
                if short is None:
                    yield counted(owner, here=True)
                else:
                    kept = found.setdefault(part, ([], [], []))
                    kept[0].append(np.frombuffer(short, "<u4"))
                    kept[1].append(owner)
                    kept[2].append(np.unpackbits(np.frombuffer(many, np.uint8), count=len(owner)).astype(bool))
        for lists in found.values():
            short, owner, many = (np.concatenate(x) for x in lists)
            order = np.lexsort((owner, short))
            short, owner, many = short[order], owner[order], many[order]
            fresh = np.concatenate(([True], (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])))
            short, owner, many = short[fresh], owner[fresh], many[fresh]
            begins = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
            runs = np.diff(np.append(begins, len(short)))
            yield counted(owner[np.repeat(runs > 1, runs) & ~many], here=False)

    counts = dealt.repartition(parts, "part").mapInArrow(count, "class long, dealt long, here long")
    return counts.groupBy("class").agg((F.sum("dealt") + F.max("here")).alias("shared"))


def full_sets(texts: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes of ``doc_id, text, class``, once each."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1))
            own = [i for i, (c, w) in enumerate(zip(_classes(flat, starts), batch.column(2).to_pylist(), strict=True)) if c is not None and c == w]
            sizes = np.diff(starts)[own]
            cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[gather(starts[:-1][own], sizes)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(own, pa.int64())), sets], ["class", "shingles"])

    return texts.mapInArrow(collect, "class long, shingles array<long>").dropDuplicates(["class"])


def visits(members: DataFrame) -> DataFrame:
    """``class, block, work``: the later blocks that hold a possible partner,
    and a class's own block, with the places of lists there to be touched.

    A shingle at place i of a class, rarest first, leaves it ``rest`` more to
    share; as the first common one of a linked pair it leaves both enough.
    """
    places = members.select("class", "block", "n_shingles", F.col("n_shared").alias("size"), F.posexplode("shingles").alias("place", "shingle"))
    first = places.withColumn("rest", F.col("size") - F.col("place")).where(100 * F.col("rest") >= SIMILAR * F.col("n_shingles"))
    held = first.groupBy("shingle", "block").agg(F.max("rest").alias("most"), F.min("n_shingles").alias("least"), F.count(F.lit(1)).alias("held"))
    enough = lambda rest: (100 + SIMILAR) * F.col(rest) >= SIMILAR * (F.col("n_shingles") + F.col("least"))
    asked = first.alias("q").join(held.alias("h"), (F.col("q.shingle") == F.col("h.shingle")) & (F.col("q.block") <= F.col("h.block")) & enough("rest") & enough("most"))
    return asked.groupBy("class", F.col("q.block").alias("home"), F.col("h.block").alias("block")).agg(F.sum("held").alias("work"))


class Block(Lists):
    """The inverted lists of a block's classes, and their set sizes."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        super().__init__(sets)
        self.sizes = np.array(sizes, np.int64)
        #: The lists end to end as one rising sequence, for binary search.
        self.keys = np.repeat(np.arange(len(self.values)), np.diff(self.bounds)) * len(sets) + self.members

    def search(self, shingles: np.ndarray, size: int, after: int = -1) -> np.ndarray:
        """The members past ``after`` that link with a set of ``size`` that has
        the given shared shingles."""
        lists = self.of(shingles)
        threshold = max(least_overlap(size), needed(size, int(self.sizes.min())))
        if len(lists) < threshold:
            return np.zeros(0, np.int64)
        lengths = self.bounds[lists + 1] - self.bounds[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        set_aside = min(threshold - 1, int(threshold / (MU * np.log2(max(2, int(lengths.max()))) + 1)))
        short, long = lists[: len(lists) - set_aside], lists[len(lists) - set_aside :]
        merged = [self.members[self.bounds[i] : self.bounds[i + 1]].tolist() for i in short.tolist()]
        found, counts = merge_skip(merged, threshold - set_aside, after + 1)
        if not found:
            return np.zeros(0, np.int64)
        candidates, overlap = np.array(found), np.array(counts)
        probes = (long[:, None] * len(self.sizes) + candidates[None, :]).ravel()
        place = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
        overlap += (self.keys[place] == probes).reshape(len(long), len(candidates)).sum(axis=0)
        sizes = self.sizes[candidates]
        return candidates[100 * overlap >= SIMILAR * (size + sizes - overlap)]


def merge_skip(lists: list[list[int]], threshold: int, start: int) -> tuple[list[int], list[int]]:
    """The numbers from ``start`` that at least ``threshold`` of the rising
    lists hold, and how many do.

    A heap holds the next number of every list.  Where the least of them occurs
    too seldom, the next ``threshold - 1`` cursors leap by binary search to the
    number after them: nothing before it can occur often enough.
    """
    heap = []
    for k, numbers in enumerate(lists):
        at = bisect_left(numbers, start)
        if at < len(numbers):
            heap.append((numbers[at], k, at))
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= threshold:
        least, taken = heap[0][0], []
        while heap and heap[0][0] == least:
            taken.append(heapq.heappop(heap))
        if len(taken) >= threshold:
            found.append(least)
            counts.append(len(taken))
            target = least + 1
        else:
            while heap and len(taken) < threshold - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, k, at in taken:
            numbers = lists[k]
            at = bisect_left(numbers, target, at)
            if at < len(numbers):
                heapq.heappush(heap, (numbers[at], k, at))
    return found, counts


LINKS = "a long, b long, class long, n_links long"


def searched(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spanning links ``a, b`` and link counts ``class, n_links`` of all visits.

    ``sizes`` tells how many documents a class stands for."""
    rows = members.join(sizes, "class").select("class", "block", "n_shingles", "n_documents", "shingles")

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        names, sizes, weights = (batch.column(k).to_pylist() for k in (3, 4, 5))
        values, cuts = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
        for k, row in enumerate(zip(names, sizes, weights, strict=True)):
            yield *row, np.sort(values[cuts[k] : cuts[k + 1]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, forest, held, links = None, Forest(), np.zeros(0, np.int64), []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*links, strict=True)) or [[]] * 4
            links.clear()
            return _batch(**{name: (values, pa.int64()) for name, values in zip(["a", "b", "class", "n_links"], columns, strict=True)})

        def counted() -> None:
            links.extend((None, None, member[0], int(n)) for member, n in zip(unit.members if unit else [], held, strict=True) if n)

        for now, (name, size, weight, shingles), after in searches(batches, rows_of, lambda group: Block([g[3] for g in group], [g[1] for g in group])):
            if now is not unit:
                counted()
                unit, forest, held = now, Forest(), np.zeros(len(now.members), np.int64)
            found = unit.index.search(shingles, size, after).tolist()
            for k in found:
                held[k] += weight
                if forest.join(name, unit.members[k][0]):
                    links.append((name, unit.members[k][0], None, None))
            if found:
                links.append((None, None, name, sum(unit.members[k][2] for k in found)))
            if len(links) > 100_000:
                yield flushed()
        counted()
        yield flushed()

    return dealt(rows, staged(visits(members), "visits"), WORK).mapInArrow(search, LINKS)


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``docs``.

    ``n_links`` counts the other documents that a document is linked with."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(sets_of(docs, id_col, text_col), "sets")
    named = rows.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(named.groupBy("class", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("n_documents")), "classes")

    with small_batches(spark):
        counts = shared_counts(marks(texts.where("doc_id IS NOT NULL"), parts), parts)
        smallest = F.ceil(F.col("n_shingles") * SIMILAR / 100)
        able = classes.join(counts, "class").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(smallest / 10)))
        able = staged(able.select("class", "n_shingles", "doc_id", "n_documents"), "able")
        wanted = able.select("doc_id", "class")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        sets = staged(full_sets(texts.join(wanted, "doc_id").select("doc_id", "text", "class")), "shingles")
    sets = sets.select("class", F.explode("shingles").alias("shingle"))
    frequent = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")
    known = sets.join(frequent, "shingle").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("frequency", "shingle"))).alias("found"))
    known = known.select("class", F.size("found").cast("long").alias("n_shared"), F.col("found.shingle").alias("shingles"))
    ordered = known.join(able.select("class", "n_shingles"), "class").where(100 * F.col("n_shared") >= SIMILAR * F.col("n_shingles"))
    room = F.greatest("n_shared", F.lit(BLOCK_SHINGLES // BLOCK_CLASSES)).cast("long").alias("room")
    laid_out = staged(ordered.select("class", "n_shingles", "n_shared", "shingles", F.array_min("shingles").alias("place"), room), "ordered")
    members = staged(in_stretches(laid_out, ["place", "class"], BLOCK_SHINGLES), "blocks")

    found = staged(searched(members, able.select("class", "n_documents")), "links")
    labels = connected_components(found.where("a IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
    firsts = labels.join(classes.select("class", "doc_id"), "class").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    linked = labels.join(firsts, "label").select("class", "smallest")
    links = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    final = classes.join(linked, "class", "left").join(links, "class", "left").select(
        "class", F.coalesce("smallest", "doc_id").alias("smallest"), (F.coalesce("n_links", F.lit(0)) + F.col("n_documents") - 1).alias("n_links")
    )
    out = rows.select("doc_id", "n_shingles", "class").join(final, "class", "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(has_id, F.coalesce("smallest", "doc_id")).alias("component_id"), F.when(has_id, F.coalesce("n_links", F.lit(0))).alias("n_links"))
