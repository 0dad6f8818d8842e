"""Near-duplicate documents by MinHash with tensored tables.

A document is its set of distinct ``SHINGLE``-word shingles (A-Z lower-cased).
Two small collections of ``GROUPS`` groups of ``DEPTH`` minhashes give
``GROUPS ** 2`` tables: table (i, j) is keyed by group i of the one and group
j of the other.  So 2 * GROUPS * DEPTH minhashes serve where independent
tables would need GROUPS ** 2 * 2 * DEPTH.  A pair at the threshold of 0.75
misses all 256 tables with probability 2 * (1 - 0.75 ** 3) ** 16 = 3e-4, one
at 0.8 with 4e-5; what tables propose is confirmed on the full sets.

Steps, none of which forms all pairs of a group:

1. Equal sets fall into a class; from here on a class counts once.
2. Every class is compared with one other, its pivot: of the leaders of its
   groups, the one it shares most groups with.  A group's leader is the class
   that shares most groups with anybody, which is the text in the middle of a
   family of copies.  Confirmed links are contracted to components.
3. Groups that lie within one component are dropped.  The classes of the others
   are laid out in blocks (``blocks``), those with a common pivot side by side.
   A class visits the blocks that hold a class of another component with an
   equal group on either side; there the candidates are those that share a
   table with it, and overlaps are counted on the inverted lists of the full
   sets, all of a block's at once.  Pairs never become rows: f open classes of
   a family cost f * f / (2 * BLOCK_CLASSES) visits at most, each a pass over
   the lists of one set, and give at most one row for each component joined.

Defined cases: fewer words than ``SHINGLE`` make one shingle of the whole
sequence; a null or empty text, or one without words, has no shingles and is
linked with nothing; a null id is linked with nothing, has a null component
and is kept; rows that repeat an id each get the component of their own text.
Very long texts are handled alone; an empty table gives no rows.  Other columns
are ignored.  ``without_copies`` decides row by row: of each component one text
of the smallest id stays, and one row of it; rows without words or without id
stay, repeated ones once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.blocks import Forest, Lists, dealt, in_stretches, searches
from accesslens.llm.components import connected_components
from accesslens.llm.staging import staged
from accesslens.llm.words import gather, hashes, slices, split_words, text_of

SHINGLE = 5
GROUPS, DEPTH = 16, 3
HASHES = 2 * GROUPS * DEPTH
#: Bits of each minhash that are kept as marks, and numbers they fill; a linked
#: pair differs in 48 of the 384 on average.
MARK_BITS = 4
MARKS = [f"mark_{i}" for i in range(HASHES * MARK_BITS // 64)]
#: Bits up to which a class is compared with its pivot, link or not.
NEARBY = 150
#: Ids up to which a lookup is broadcast (about 10 MB); beyond it is shuffled.
BROADCAST_ROWS = 400_000
SIMILAR = 75  # per cent
#: A block's size, in classes and in shingles, and the list places a task touches.
BLOCK_CLASSES, BLOCK_SHINGLES, WORK = 4096, 2_000_000, 4_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "doc_id long, print long, n_shingles long, class long, sides array<long>, " + ", ".join(f"{m} long" for m in MARKS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split_words(text_of(column), lower=True)
    each = hashes(words.uniques)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    size = max(0, len(each) - SHINGLE + 1)
    rolled = np.zeros(size, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * PRIME + each[k : k + size]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(each[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).view(np.int64)))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` minima of each (non-empty) set."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    seeds = np.random.default_rng(20).integers(0, 1 << 63, (2, HASHES), np.uint64)
    return np.stack([np.minimum.reduceat((flat ^ a) * (b | np.uint64(1)), starts) for a, b in zip(*seeds, strict=True)], axis=1)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: set size, class, group keys of both sides, short marks."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sides: list = [None] * len(sets)
            marks = np.zeros((len(sets), len(MARKS)), np.int64)
            classes: list = [None] * len(sets)
            if len(full):
                minima = minhashes([sets[i] for i in full])
                keys = np.zeros((len(full), 2 * GROUPS), np.uint64)
                for k in range(DEPTH):
                    keys = keys * PRIME + minima[:, k::DEPTH]
                keys = _mixed(keys + np.arange(2 * GROUPS, dtype=np.uint64)).view(np.int64)
                bits = _mixed(minima) & np.uint64((1 << MARK_BITS) - 1)
                each = 64 // MARK_BITS
                for k in range(each):
                    marks[full] |= (bits[:, k::each] << np.uint64(MARK_BITS * k)).view(np.int64)
                for row, i in enumerate(full.tolist()):
                    classes[i], sides[i] = class_of(sets[i]), keys[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(sides, pa.list_(pa.int64())), *(pa.array(m) for m in marks.T)],
                ["doc_id", "print", "n_shingles", "class", "sides", *MARKS],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print")).mapInArrow(sketch, SKETCH)


def shared_groups(rows: DataFrame, by: str) -> DataFrame:
    """The rows of ``class, side, key`` whose key has several ``by``, with the
    number ``n`` of rows of the key."""
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("low"), F.max(by).alias("high")).where("low < high")
    return rows.join(keys.select("key", "n"), "key")


def pivots(groups: DataFrame) -> DataFrame:
    """``class, pivot``: the leader each class shares most groups with."""
    central = groups.groupBy("class").agg(F.sum("n").alias("central"))
    ranked = groups.join(central, "class")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("central", "class")).alias("best")).select("key", F.col("best.class").alias("leader"), F.col("best.central").alias("central"))
    stars = groups.join(leaders, "key").where("class != leader").groupBy("class", "leader", "central").agg(F.count(F.lit(1)).alias("n"))
    return stars.groupBy("class").agg(F.max(F.struct("n", "central", "leader")).alias("best")).select("class", F.col("best.leader").alias("pivot"))


def apart(x: str, y: str) -> Column:
    """In how many bits the marks of two joined rows differ."""
    return sum((F.bit_count(F.col(f"{x}.{mark}").bitwiseXOR(F.col(f"{y}.{mark}"))) for mark in MARKS), F.lit(0))


def shingles_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``class, shingles`` of the representatives ``reps`` (doc_id, class)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1))
            classes, wanted = [class_of(s) for s in sets], batch.column(2).to_pylist()
            own = [i for i, c in enumerate(classes) if c == wanted[i]]
            yield pa.RecordBatch.from_arrays([pa.array([classes[i] for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["class", "shingles"])

    wanted = reps.select("doc_id", "class")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id")
    return texts.select("doc_id", "text", "class").mapInArrow(collect, "class long, shingles binary").dropDuplicates(["class"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets are linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def visits(groups: DataFrame) -> DataFrame:
    """``class, home, block, work``: the blocks, from its own on, that hold a
    class of another component with an equal group on both sides."""
    held = groups.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("held"))
    others = (F.col("h.low") != F.col("q.label")) | (F.col("h.high") != F.col("q.label"))
    asked = groups.alias("q").join(held.alias("h"), (F.col("q.key") == F.col("h.key")) & (F.col("q.block") <= F.col("h.block")) & others)
    counted = asked.groupBy("class", F.col("q.block").alias("home"), F.col("h.block").alias("block")).agg(
        F.min("side").alias("first"), F.max("side").alias("last"), F.sum("held").alias("work")
    )
    return counted.where((F.col("first") < GROUPS) & (F.col("last") >= GROUPS)).select("class", "home", "block", "work")


class Block(Lists):
    """A block's classes: groups, labels and sizes next to the inverted lists."""

    def __init__(self, group: list[tuple]):
        super().__init__([row[4] for row in group])
        self.labels, self.sizes = (np.array([row[k] for row in group]) for k in (1, 2))
        self.sides = np.stack([row[3] for row in group])

    def search(self, label: int, size: int, sides: np.ndarray, shingles: np.ndarray, after: int) -> np.ndarray:
        """The members past ``after`` with another label that share a table
        with a set and are linked with it."""
        equal = self.sides == sides
        able = equal[:, :GROUPS].any(axis=1) & equal[:, GROUPS:].any(axis=1) & (self.labels != label)
        able &= 100 * np.minimum(self.sizes, size) >= SIMILAR * np.maximum(self.sizes, size)
        able[: after + 1] = False
        if not able.any():
            return np.zeros(0, np.int64)
        lists = self.of(shingles)
        touched = self.members[gather(self.bounds[lists], self.bounds[lists + 1] - self.bounds[lists])]
        overlap = np.bincount(touched, minlength=self.size)
        return np.flatnonzero(able & (100 * overlap >= SIMILAR * (self.sizes + size - overlap)))


def searched(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Links ``a, b`` that join components, as many as it takes in a task."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        names, labels, sizes = (batch.column(k).to_pylist() for k in (3, 4, 5))
        sides = batch.column(6).values.to_numpy().reshape(-1, 2 * GROUPS)[batch.column(6).offset :]
        for row in zip(names, labels, sizes, sides, batch.column(7), strict=True):
            yield *row[:4], np.frombuffer(row[4].as_buffer(), np.uint64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, forest, links = None, Forest(), []
        for now, (name, label, size, sides, shingles), after in searches(batches, rows_of, Block):
            if now is not unit:
                unit, forest = now, Forest()
            for k in now.index.search(label, size, sides, shingles, after).tolist():
                if forest.join(label, now.members[k][1]):
                    links.append((name, now.members[k][0]))
        yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in range(2)], ["a", "b"])

    return dealt(members, asked, WORK).mapInArrow(search, "a long, b long")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, print, n_shingles, class, label, smallest`` of every row: the
    component's name among classes and its smallest id."""
    rows = staged(sketches(docs, id_col, text_col), "sketches")
    named = rows.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(named.groupBy("class").agg(F.min("doc_id").alias("first_id")), "classes")
    reps = named.join(classes.withColumnRenamed("first_id", "doc_id"), ["class", "doc_id"]).select("class", "doc_id", "n_shingles", "sides", *MARKS)
    reps = staged(reps.dropDuplicates(["class"]), "representatives")
    marked = reps.select("class", *MARKS)

    groups = reps.select("class", F.posexplode("sides").alias("side", "key"))
    groups = staged(shared_groups(groups, "class"), "groups")
    nearest = staged(pivots(groups), "pivots")
    pairs = nearest.alias("p").join(marked.alias("x"), F.col("p.class") == F.col("x.class")).join(marked.alias("y"), F.col("p.pivot") == F.col("y.class"))
    pairs = staged(pairs.where(apart("x", "y") <= NEARBY).select(F.col("p.class").alias("a"), F.col("p.pivot").alias("b")), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = staged(shingles_of(docs, reps.join(ends, "class", "left_semi"), id_col, text_col), "shingles")
    labels = connected_components(staged(compared(pairs, sets), "links"))

    labelled = groups.select("class", "side", "key").join(labels.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.select("class", "side", "key", F.coalesce("label", "class").alias("label"))
    opened = staged(shared_groups(labelled, "label"), "open-groups")
    able = opened.groupBy("class", "label").agg(F.min("side").alias("first"), F.max("side").alias("last")).where((F.col("first") < GROUPS) & (F.col("last") >= GROUPS))
    sets = staged(shingles_of(docs, reps.join(able, "class", "left_semi"), id_col, text_col), "open-shingles")
    room = F.greatest("n_shingles", F.lit(BLOCK_SHINGLES // BLOCK_CLASSES)).cast("long").alias("room")
    members = able.select("class", "label").join(reps, "class").join(sets, "class").join(nearest, "class", "left")
    members = staged(members.select("class", "label", "n_shingles", "sides", "shingles", F.coalesce("pivot", "class").alias("place"), room), "open-classes")
    members = staged(in_stretches(members, ["place", "class"], BLOCK_SHINGLES).drop("place"), "blocks")
    asked = staged(visits(opened.join(members.select("class", "block"), "class")), "visits")
    second = staged(searched(members, asked), "links")

    found = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(second)).withColumnRenamed("node", "class")
    smallest = found.join(classes, "class").groupBy("label").agg(F.min("first_id").alias("smallest"))
    linked = found.join(smallest, "label").select("class", "label", "smallest")
    final = classes.join(linked, "class", "left").select("class", F.coalesce("label", "class").alias("label"), F.coalesce("smallest", "first_id").alias("smallest"))
    return rows.select("doc_id", "print", "n_shingles", "class").join(final, "class", "left")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    return _labelled(docs, id_col, text_col).select("doc_id", "n_shingles", component.alias("component_id"), kept)


#: Columns that ``without_copies`` adds for its own use.
ID, PRINT = "_copy_of_id", "_copy_of_text"


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that stay: of each component one row
    of one text, and the rows without words or id, repeated ones once."""
    rows = staged(_labelled(docs, id_col, text_col), "labelled")
    own = rows.where("class IS NOT NULL AND doc_id = smallest").groupBy("label").agg(F.min("class").alias("class"))
    chosen = rows.join(own.withColumn("first", F.lit(True)), ["label", "class"], "left")
    stays = F.col("class").isNull() | F.col("doc_id").isNull() | (F.coalesce("first", F.lit(False)) & (F.col("doc_id") == F.col("smallest")))
    told = chosen.groupBy(F.col("doc_id").alias(ID), F.col("print").alias(PRINT)).agg(F.max(stays).alias("stays"), (F.count(F.lit(1)) > 1).alias("repeated"))
    told = staged(told.where("repeated OR NOT stays"), "decisions")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told  # else the texts are shuffled
    keyed = docs.withColumns({ID: F.col(id_col).cast("long"), PRINT: F.xxhash64(text_col)})
    same = (keyed[ID].eqNullSafe(told[ID])) & (keyed[PRINT] == told[PRINT])
    alone = keyed.join(told, same, "left_anti")
    # A repeated row is chosen by the rest of its columns.
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(c).cast("string") for c in docs.columns]), {"ignoreNullFields": "false"}))
    again = keyed.join(told.where("stays"), same, "left_semi")
    again = again.withColumn("_n", F.row_number().over(Window.partitionBy(ID, PRINT).orderBy(rest))).where("_n = 1")
    return alone.select(docs.columns).unionByName(again.select(docs.columns))
