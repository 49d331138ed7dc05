"""Connected components of a graph of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut


#: So many edges are no work to deal out: they stay in one task.
FEW = 50_000


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (columns a, b); root is the smallest node reachable.

    In each round every node hooks to its smallest neighbour if that is smaller, chains of hooks
    are shortened until they are flat, and the edges are drawn anew between the roots. At least
    half of the nodes that still have edges go in a round; nothing is gathered anywhere, but for FEW
    edges at most, whose rounds would each be a task for every shuffle partition.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = left.count() <= FEW
    here = lambda df: df.coalesce(1) if few else df
    known = None
    while known is None or not left.isEmpty():
        both = here(left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        hooks = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while not (longer := cut(_jumped(here(hooks)))).where("moved").isEmpty():
            hooks = longer.drop("moved")
        hooks = longer.drop("moved")
        known = hooks if known is None else cut(_above(here(known), here(hooks)))
        ends = [here(hooks).select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        left = cut(here(left).join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    return known


def _above(known: DataFrame, hooks: DataFrame) -> DataFrame:
    """known with each root replaced by what hooks says of it."""
    higher = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return known.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))


def _jumped(hooks: DataFrame) -> DataFrame:
    """Each node at the root of its root, and whether that moved it."""
    higher = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return hooks.join(higher, "root").select("node", F.col("higher").alias("root"), (F.col("higher") < F.col("root")).alias("moved"))
