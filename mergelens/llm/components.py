"""Connected components of an undirected graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.llm._store import discard, materialise, table


def _small(down: DataFrame) -> DataFrame:
    """Small star of edges from ``u`` down to ``v``: every neighbour below a node, and the node itself, meet at the least of
    them."""
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return met.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) edges to (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each step is an aggregate of a minimum (combined
    before the shuffle, so a hub costs no more than another node) and a join, and each round is written as a table. The
    minima of the large step are a table too: the join then has an exchange on either side, so that a hub's edges, which
    have one key, are split among tasks as a skewed join. Tables of earlier rounds are deleted. A small-star step comes first:
    where one group was linked many times over, by stars around several of its least nodes, about one edge a node is left.
    Loops, repeated edges and nulls are ignored; an empty table gives an empty one. Raises if ``rounds`` don't suffice.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, links_at = table(links, "cc-links")
    spark = edges.sparkSession
    links = materialise(_small(links), "cc-0")
    discard(spark, links_at)
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    before, old = None, []
    for k in range(1, rounds + 1):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_at = table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"cc-least-{k}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links, links_at = table(_small(large.distinct()), f"cc-{k}")
        for path in (*old, least_at):
            discard(spark, path)
        old = [links_at]
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    found = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(found, nodes.node == found.u, "left").select("node", F.coalesce("m", "node").alias("component"))
