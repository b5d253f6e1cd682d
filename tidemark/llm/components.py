"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, store


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Only minima by node, which Spark sums up in every task first, and joins on single nodes are used, so a node
    with very many neighbours is never gathered. Each round is written to the shared folder. Edges with a null
    end or from a node to itself, and repeated edges, add nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    # u > v always: v is nearer to the root
    now = store(edges.where("a is not null and b is not null and a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        # large-star: every neighbour that is larger than the node moves to the node's smallest neighbour
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        last, now = now, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node's smaller neighbours and the node itself move to the smallest of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def merged_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of `groups`, as connected_components gave them, with more edges (a, b): only the
    components that the new edges touch are joined anew."""
    named = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    ends = edges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    new = store(connected_components(ends).withColumnsRenamed({"node": "old", "component": "new"}), "components")
    kept = groups.join(new, groups["component"] == new["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = new.join(groups, new["old"] == groups["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return store(kept.unionAll(alone), "components")
