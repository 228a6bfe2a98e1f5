"""Connected components: of any edge table by alternating large-star and small-star steps, of a
forest of links to smaller nodes by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are joined to the least of them and the node itself: those
    above the node (large), or the node and those below it (small)."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    star = both.where("v > u") if large else both
    out = star.join(least, star.u == least.c).select("v", "m")
    if not large:
        out = out.union(least.select("c", "m"))
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the least node that it
    reaches. Nodes without an edge to another are left out; loops and repeats are allowed."""
    now, k = work.cut(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0"), 0
    check = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    seen = None
    while True:
        state = now.agg(check.alias("c")).first()["c"]
        if seen == state or not state["n"]:
            break
        seen, k = state, k + 1
        now = work.cut(_stars(_stars(now, True), False), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v")).distinct()


def roots(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for each node of links (u, v), where each u has one row and v < u: component is the
    node at the end of its chain, the least of its tree. Each step halves the chains that are left.

    Both sides of a step's join are written tables, so that Spark can split a v that many nodes have.
    """
    now, k = work.cut(links.select("u", "v"), f"{name}-0"), 0
    while True:
        k += 1
        up = now.select(F.col("u").alias("v"), F.col("v").alias("w"))
        # A chain of one link has its end already.
        step = now.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        step = work.cut(step, f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        now = step.select("u", "v")
        if step.where("moved").isEmpty():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
