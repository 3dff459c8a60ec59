"""Connected components by alternating large-star and small-star, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stored


def _star(directed: DataFrame) -> DataFrame:
    """``directed`` (u, v) with m, the least of u and its v's.

    The minimum is pre-aggregated, so a hub costs one row a task, and stored, so that both sides of
    the join are plain exchanges and adaptive execution can split a hub's partition.
    """
    least = stored(directed.groupBy("u").agg(F.min("v").alias("m")), "least", files_a_core=4)
    return directed.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node, as ``_large`` leaves them."""
    star = _star(edges)
    moved = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(star.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one. One pre-aggregated pass."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    by_node = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    worst = by_node.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0))).first()[0]
    return worst is None or worst <= 1


def as_stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of a few nodes as (node, least node of its component)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up) if root(x) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the least node reachable.

    Nulls and self-links count for nothing. Every round is a written table, so a lost executor costs one round at most.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", files_a_core=4)
    while not _are_stars(now):
        large = stored(_large(now), "large", files_a_core=4)
        drop(now)
        now = stored(_small(large), "edges", files_a_core=4)
        drop(large)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(out.select(F.col("component").alias("node"), "component").distinct())
