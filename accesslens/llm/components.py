"""Connected components of a link table, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.staging import staged


def _toward_smallest(edges: DataFrame) -> DataFrame:
    """One large-star step: every node's larger neighbours move to the
    smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """One small-star step: a node and its smaller neighbours move to the
    smallest of them.  Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (two id columns ``a, b``):
    the smallest node id it reaches.

    Large-star and small-star steps alternate until the edges no longer
    change: then every node points at its label.  A node with very many links
    costs one aggregated row a task, and a skewed join that Spark can split.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while before[0]:
        edges = staged(_smaller_to_smallest(_toward_smallest(edges)), "links")
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
