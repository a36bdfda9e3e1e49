"""Connected components as joins and groupings: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.store import kept, small_side


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the smallest node of its component.

    Each round points every node to its smallest neighbour and replaces edges
    by edges between the nodes pointed to, until none is left; the pointers of
    the rounds are then followed one after the other. A node with very many
    neighbours is reduced before it is shuffled.
    """
    left = _plain(edges)
    left = kept(left, "edges")
    steps: list[DataFrame] = []
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("to"))
        points = kept(points, "points")
        steps.append(points)
        to_a = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(to_a, "a").join(to_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        reached = points.select(F.col("to").alias("node")).distinct().join(points, "node").select(
            F.col("node").alias("a"), F.col("to").alias("b"))
        left = kept(_plain(moved.union(reached)), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for points in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots = points.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    return kept(roots, "roots")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links (a, b): only the components that these touch are worked on."""
    def side(name: str) -> DataFrame:
        return roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))

    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = components(between)
    later = small_side(moved.select(F.col("node").alias("root"), F.col("root").alias("later")))
    same = roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return kept(same.union(moved.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _plain(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
