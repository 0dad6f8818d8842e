"""Chat formatting of reply trees.

A tree's nodes point at the node they reply to.  Self-joins that double the
distance each time find, in as many rounds as the deepest path has binary
digits, every node's depth and the score of its path to the root; no step
gathers a tree.  Leaves are ranked by the mean score of their path, and the
chosen paths are listed by the same jumps, largest first, so that every node
of a path comes up once.  Each path becomes one conversation: a row a turn in
order, with its formatted text and the span of it that a loss counts.

The template marks a turn as ``<s>[role]``, newline, text, ``</s>``, newline.
Inside roles and texts a backslash is written twice, ``<`` as ``\\l`` and
``[`` as ``\\b``: no control string can appear there, and reading is exact.

Defined cases: a null text or role is empty; a parent that does not exist
makes a root; nodes on a cycle, or above which there is one, have no path and
are left out; ties between leaves go to the smaller node id; equal rows of a
conversation are turns of their own; a null conversation id is an id like any
other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

ASSISTANT = "assistant"
TURN = re.compile(r"<s>\[(.*?)\]\n(.*?)</s>\n", re.DOTALL)
ESCAPES = {"\\\\": "\\", "\\l": "<", "\\b": "["}
DIGESTS = "tree long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: ESCAPES[m[0]], text)


def numbered_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``tree, node, parent, role, text``: every turn replies to the one before.

    Nodes are numbered along a range-partitioned sort, which splits a long
    conversation, and find the turn before by an equality join on the number.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")]
    placed = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    bases, total = [], 0
    for row in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a task
        bases.append((row.part, total))
        total += row.n
    base = turns.sparkSession.createDataFrame(bases, "part long, base long")
    nodes = staged(placed.join(base, "part").select("tree", (F.col("base") + F.col("place")).alias("node"), "role", "text"), "nodes")
    before = nodes.select((F.col("node") + 1).alias("node"), F.col("tree").alias("tree_before"))
    parent = F.when(F.col("tree").eqNullSafe(F.col("tree_before")), F.col("node") - 1)
    return nodes.join(before, "node", "left").select("tree", "node", parent.alias("parent"), "role", "text")


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """``tree, rank, position, node`` of the ``paths`` best root-to-leaf paths
    of each tree; ``nodes`` has tree, node, parent and score."""
    links = nodes.select("node", F.col("parent").alias("up"), F.col("score").cast("double").alias("score"))
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    state = links.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    state = staged(state, "paths")
    total, jumps = state.count(), []
    while state.where("up IS NOT NULL").limit(1).count() and 1 << len(jumps) <= total:
        jumps.append(state.where("up IS NOT NULL").select("node", "up"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("further"))
        joined = state.join(above, "up", "left")
        state = staged(joined.select("node", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")), "paths")
    rooted = state.where("up IS NULL").join(nodes.select("node", "tree"), "node")
    leaves = rooted.join(nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)
    members = staged(chosen.select("tree", "rank", F.col("depth").alias("position"), "node"), "members")
    for k in range(len(jumps) - 1, -1, -1):
        further = members.join(jumps[k], "node").select("tree", "rank", (F.col("position") - (1 << k)).alias("position"), F.col("up").alias("node"))
        members = staged(members.unionByName(further), "members")
    return members


def formatted(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, rank, position, segment, loss_from, loss_to``: each path's
    turns; the loss span is in characters of the segment, null for none."""
    rows = members.select("tree", "rank", "position", "node").join(nodes.select("node", "role", "text"), "node")
    head, body = F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("]\n")), escaped(F.col("text"))
    rows = rows.select("tree", "rank", "position", "role", head.alias("head"), body.alias("body"))
    own = F.col("role") == ASSISTANT
    return rows.select(
        "tree", "rank", "position", F.concat("head", "body", F.lit("</s>\n")).alias("segment"),
        F.when(own, F.char_length("head")).alias("loss_from"), F.when(own, F.char_length("head") + F.char_length("body")).alias("loss_to"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, one row each.

    A digest over a whole conversation has to see its turns in order, so one
    task reads them, as a stream: it holds a batch of turns, not a conversation.
    """
    ordered = segments.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "position")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, loss, counts, done = None, None, None, [0, 0, 0], []

        def close() -> None:
            if key is not None:
                done.append((*key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            names = [part.split()[0] for part in DIGESTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for tree, rank, segment, start, stop in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != (tree, rank):
                    close()
                    key, turns, loss, counts = (tree, rank), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                whole = TURN.fullmatch(segment)
                turns.update(f"{unescaped(whole[1])}\n{unescaped(whole[2])}\n".encode())
                counts[0] += 1
                counts[2] += len(segment)
                if start is not None:
                    said = unescaped(segment[start:stop])
                    loss.update(said.encode())
                    counts[1] += len(said)
            if done:
                yield batch_of()
                done.clear()
        close()
        yield batch_of()

    return ordered.select("tree", "rank", "segment", "loss_from", "loss_to").mapInArrow(read, DIGESTS)


def format_conversations(spark: SparkSession, turns: DataFrame, **columns: str) -> DataFrame:
    """Format linear conversations, each a tree of one path, and read them
    back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    nodes = staged(numbered_turns(turns, **columns).withColumn("score", F.lit(0.0)), "reply-tree")
    segments = staged(formatted(best_paths(nodes), nodes), "formatted")
    return read_back(segments).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
