"""Graph JSON to node and edge tables (SRC-2, 10, 11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from .documents import read_documents

_NODE = "struct<id: string, label: string, name: string, type: string, node_type: string, desc: string, source: string>"
_EDGE = "struct<source: string, target: string, relationship: string, relation: string, desc: string, description: string>"


def parse_graphs(docs: DataFrame, legacy_relation_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents (doc_id, body), in their order.

    Missing labels are empty, missing types `unknown`. A later node of an id, and a later edge of the
    same ends, replaces the earlier one's data and keeps its place. Ends without a node become nodes.
    legacy_relation_key reads only `relation`.
    """
    body = F.from_json("body", f"struct<nodes: array<{_NODE}>, edges: array<{_EDGE}>>")
    parsed = docs.select(F.col("doc_id").alias("graph_id"), body.alias("g"))
    nodes = parsed.select("graph_id", F.posexplode("g.nodes").alias("ord", "n")).where("n.id IS NOT NULL")
    nodes = nodes.select("graph_id", F.col("n.id").alias("id"), F.coalesce("n.label", F.lit("")).alias("label"), F.coalesce("n.type", F.lit("unknown")).alias("type"), F.coalesce("n.node_type", F.lit("entity")).alias("node_type"), F.col("ord").cast("long").alias("ord"))
    edges = parsed.select("graph_id", F.posexplode("g.edges").alias("ord", "e")).where("e.source IS NOT NULL AND e.target IS NOT NULL")
    relation = F.col("e.relation") if legacy_relation_key else F.coalesce("e.relationship", "e.relation")
    edges = edges.select("graph_id", F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.coalesce(relation, F.lit("")).alias("relation"), F.coalesce("e.desc", "e.description").alias("desc"), F.col("ord").cast("long").alias("ord"))
    nodes = graph.last_wins(nodes, ["graph_id", "id"], keep_first_position=True)
    edges = graph.last_wins(edges, ["graph_id", "source", "target"], keep_first_position=True)
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    implicit = ends.select("graph_id", "id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("type"), F.lit("entity").alias("node_type"), F.lit(1 << 40).alias("ord"))
    return nodes.unionByName(implicit), edges


def load_graph(spark: SparkSession, path: str, **how) -> tuple[DataFrame, DataFrame]:
    return parse_graphs(read_documents(spark, path), **how)


def evaluation_entities(nodes: DataFrame) -> DataFrame:
    """name, type of nodes to be scored: events and blank labels left out."""
    kept = nodes.where("node_type <> 'event'").where(~T.is_blank(F.col("label")))
    return kept.select("id", F.trim("label").alias("name"), F.coalesce("type", F.lit("unknown")).alias("type"))
