"""Neighbourhoods and short paths (GRA-9..11, 17). Frontiers grow by joins; a visited set keeps them from growing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def reached(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """seed, seed_ord, id, hops: nodes within `radius` out-edges of each seed (id, seed_ord)."""
    steps = edges.select("source", "target").distinct()
    seen = seeds.select(F.col("id").alias("seed"), "seed_ord", "id", F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, radius + 1):
        new = frontier.join(steps, frontier.id == steps.source).select("seed", "seed_ord", F.col("target").alias("id")).distinct()
        frontier = new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(k)).select(seen.columns)
        seen = seen.unionByName(frontier)
    return seen


def ego_edges(edges: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """Edges among the nodes reached from a seed, each once, at the first seed that has it (seed_ord)."""
    near = reached(edges, seeds, radius)
    a = near.select("seed", "seed_ord", F.col("id").alias("source"))
    b = near.select("seed", F.col("id").alias("target"))
    both = a.join(edges, "source").join(b, ["seed", "target"])
    rest = [c for c in edges.columns if c not in ("source", "target")]
    best = both.groupBy("source", "target", *rest).agg(F.min("seed_ord").alias("seed_ord"))
    return best.select("seed_ord", "source", "target", *rest)


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_edges: int, undirected: bool = False) -> DataFrame:
    """start, end, path, relations: for each pair the shortest path of at most max_edges, the smallest of equals.

    Each round keeps one path per (start, node) reached at that length, so rows stay below
    starts x nodes however many paths there are.
    """
    steps = edges.select("source", "target", "relation")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation"))
    steps = steps.groupBy("source", "target").agg(F.min("relation").alias("relation"))
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"))
    frontier = seen
    for _ in range(max_edges):
        grown = frontier.join(steps, frontier.node == steps.source).select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"))
        fresh = grown.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        best = fresh.groupBy("start", "node").agg(F.min(F.struct("path", "relations")).alias("b"))
        frontier = materialise(best.select("start", "node", F.col("b.path").alias("path"), F.col("b.relations").alias("relations")), "frontier")
        seen = seen.unionByName(frontier)
    wanted = ends.select(F.col("id").alias("node")).distinct()
    return seen.join(wanted, "node", "left_semi").where("start <> node").select("start", F.col("node").alias("end"), "path", "relations")


def pattern(nodes: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """Edges in either direction between a node of the first type and one of the second: first, second, relation, forward."""
    a = nodes.where(F.col("type") == first).select(F.col("id").alias("first"))
    b = nodes.where(F.col("type") == second).select(F.col("id").alias("second"))
    ahead = edges.select(F.col("source").alias("first"), F.col("target").alias("second"), "relation", F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("first"), F.col("source").alias("second"), "relation", F.lit(False).alias("forward"))
    return ahead.unionByName(back).join(a, "first", "left_semi").join(b, "second", "left_semi").select("first", "second", "relation", "forward")


def focus(edges: DataFrame, node_id: str) -> DataFrame:
    """id of the node and its neighbours in both directions."""
    near = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    return near.select(F.explode(F.array("source", "target", F.lit(node_id))).alias("id")).distinct()
