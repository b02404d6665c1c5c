"""Connected components by minimum hooking and pointer jumping, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.session import Scratch


def jump_to_roots(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(`node`, `root`) for (`node`, `to`), where following `to` from any node ends at a node that points to itself.

    Each pass follows two pointers at once and is then followed itself, so paths shrink to a third or less: the passes
    grow with the logarithm of the longest path. Nodes that are only pointed at count as roots.
    """
    now = pointers.select("node", "to")
    while True:
        targets = now.where("node <> to")
        one, two = (targets.select(F.col("node").alias(f"mid{i}"), F.col("to").alias(f"next{i}")) for i in (1, 2))
        step = scratch.save(
            now.join(one, F.col("to") == F.col("mid1"), "left").join(two, F.col("next1") == F.col("mid2"), "left")
            .select("node", F.coalesce("next2", "next1", "to").alias("to"), F.col("next2").isNotNull().alias("moved"))
        )
        scratch.drop(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("node", F.col("to").alias("root"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(`node`, `root`) for every node in `edges` (`a`, `b`); the root is the smallest node of its component.

    Self-loops and repeated edges are allowed; rows with a null end are ignored; no edges give no rows.

    Round: every node hooks onto its smallest neighbour if that is smaller, pointers are jumped to the roots, and the
    edges are rewritten to the roots without loops and repeats. Hooking aggregates with map-side combine, so a node
    with a third of all edges is no hot spot. Only counts reach the driver.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    live = edges.where("a is not null and b is not null")
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node")))
    left = scratch.save(
        live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    levels: list[DataFrame] = []
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        roots = scratch.save(jump_to_roots(scratch.save(hooks), scratch))
        levels.append(roots)
        ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        moved = (
            left.join(ra, "a", "left").join(rb, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        following = scratch.save(moved)
        scratch.drop(left)
        left = following
    out = nodes.distinct().withColumn("root", F.col("node"))
    for roots in levels:
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        out = out.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return scratch.save(out)
