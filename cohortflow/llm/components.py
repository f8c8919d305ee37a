"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.session import stage

#: Pointer jumps per round. A node points at the neighbour (or itself) of smallest hash; two jumps
#: shorten most chains to one step, and the next round takes the rest.
JUMPS = 2


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of a link between two different nodes; root names its component.

    Contraction: in each round every node points at its neighbour of smallest hash, links are
    relabelled to the nodes pointed at, and links inside one node drop out. A round removes a constant
    share of the nodes that are left, so the rounds grow with the logarithm of the longest chain. Every
    round's table is written once in the shared checkpoint folder, which cuts the lineage; joins on a
    node that many others point at read both sides from shuffles, so AQE can split them.
    Null nodes and links of a node to itself are left out; repeated links count once.
    """
    links = stage(_between(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node"))).alias("near"))
        own = F.xxhash64("a")
        parent = stage(near.select(F.col("a").alias("node"), F.when(F.col("near.h") < own, F.col("near.node")).otherwise(F.col("a")).alias("root")), "parents")
        for _ in range(JUMPS):
            parent = stage(_follow(parent, parent), "parents")
        to_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = stage(_between(moved), "links")
        levels.append(parent)
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[-1]
    for level in reversed(levels[:-1]):
        out = _follow(level, out)
    return out


def _between(edges: DataFrame) -> DataFrame:
    """Links of two different nodes, once each, smaller node first."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """Roots of ``first`` replaced by their own root in ``then``, where they have one."""
    onward = then.select(F.col("node").alias("root"), F.col("root").alias("onward"))
    return first.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
