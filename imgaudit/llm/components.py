"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has one."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("root")).union(edges.select("u", F.lit(0), F.lit(1)))
    broken = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("root").alias("root")).where("low > 1 or (low > 0 and root > 0)")
    return broken.isEmpty()


def forest_roots(links: DataFrame, own: Scratch) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``, where each a has one b and no links form a cycle.

    Every node jumps to the end of its end until none moves; rounds grow with the logarithm of the
    longest chain. The component is the root's number.
    """
    up = own.write(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "jumps")
    while True:
        ends = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = own.write(up.join(ends, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "jumps")
        up = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return up.union(up.select("component", "component").distinct())


def connected_components(links: DataFrame, max_rounds: int = 60, own: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is its smallest reachable node.

    Alternating large-star and small-star steps turn the links into stars around the smallest
    node of each component. Every step is a grouped minimum and an equi-join; the number of
    steps grows with the logarithm of the longest chain. Self links and repeats are harmless,
    null ends are ignored, no links give no rows. More than ``max_rounds`` steps, enough for chains
    of 2**30 links, are an error. ``own`` takes the tables of the steps.
    """
    write = own.write if own else materialize
    both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = write(both.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    for _ in range(max_rounds):
        if _stars(edges):
            roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
        # large star: neighbours above x move to the smallest of x and its neighbours
        near = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
        low = near.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = near.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: v and its neighbours below move to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        down = large.join(low, "v")
        small = down.select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        edges = write(small, "links")
    raise RuntimeError("components did not settle; raise max_rounds")
