"""Counts, degrees and histograms of graphs (AGG-*, WIN-7, WIN-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def type_histogram(nodes: DataFrame, column: str = "type") -> DataFrame:
    return nodes.groupBy(T.title_case(F.col(column)).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by type and edges by relation, with their totals (name null)."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n")
    e = edges.rollup("relation").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "n")
    return n.unionByName(e)


def semantic_stats(nodes: DataFrame) -> DataFrame:
    """One pass over hetero nodes (node_type, type, subtype, is_generic): counts per grouping."""
    return nodes.groupingSets([["node_type", "type"], ["type", "subtype"], ["type", "is_generic"], ["node_type"], []], "node_type", "type", "subtype", "is_generic").agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def degrees(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """id, degree (in + out); a self loop counts two, or one."""
    ends = F.array("source", "target")
    if loops_once:
        ends = F.array_distinct(ends)
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def sized(degree: DataFrame, low: float = 10, high: float = 50) -> DataFrame:
    """Degree scaled to low..high between the extremes; colour tier by 20, 10, 5."""
    ends = degree.agg(F.min("degree").alias("_lo"), F.max("degree").alias("_hi"))  # one row
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    tier = F.when(F.col("degree") >= 20, "hub").when(F.col("degree") >= 10, "high").when(F.col("degree") >= 5, "middle").otherwise("low")
    return degree.join(F.broadcast(ends)).withColumns({"size": low + (high - low) * (F.col("degree") - F.col("_lo")) / span, "tier": tier}).drop("_lo", "_hi")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges (distinct ordered pairs), density m / (n (n - 1)), 0 for one node or none."""
    n = nodes.agg(F.count_distinct("id").alias("n_nodes"))
    m = edges.agg(F.count_distinct("source", "target").alias("n_edges"))
    value = F.when(F.col("n_nodes") <= 1, 0.0).otherwise(F.col("n_edges") / (F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)))
    return n.join(F.broadcast(m)).withColumn("density", value)  # one row each


def top_degrees(edges: DataFrame, n: int = 20) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def parallel_edges(edges: DataFrame, chars: int = 50) -> DataFrame:
    """One row per (source, target): sorted distinct relations, their number, a tooltip of shortened texts."""
    out = edges.groupBy("source", "target").agg(F.array_sort(F.collect_set("relation")).alias("relations"), F.count("*").alias("n_edges"))
    tip = F.array_join(F.transform("relations", lambda r: F.substring(r, 1, chars)), "\n")
    return out.withColumns({"tooltip": tip, "desc": F.concat(F.col("n_edges").cast("string"), F.lit(" relations"))})


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


def mention_sections(mentions: DataFrame) -> DataFrame:
    """entity_type, identifier, display_name, section_id, n: a row for each section that mentions an entity."""
    return mentions.groupBy("entity_type", "identifier", "display_name", "section_id").agg(F.count("*").alias("n"))


def mention_ranking(mentions: DataFrame, n: int | None = None) -> DataFrame:
    """entity_type, identifier, display_name, n_mentions, n_sections, the most mentioned first.

    The sections themselves are mention_sections(): no entity's are gathered in one place.
    """
    out = mention_sections(mentions).groupBy("entity_type", "identifier", "display_name").agg(F.sum("n").alias("n_mentions"), F.count("*").alias("n_sections"))
    out = out.orderBy(F.desc("n_mentions"), "identifier")
    return out if n is None else out.limit(n)


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Per type: all, matched and unmatched references; the total has a null type."""
    return resolved.rollup("entity_type").agg(F.count("*").alias("n"), F.count("matched_ord").alias("n_matched"), F.count_if(F.col("matched_ord").isNull()).alias("n_unmatched"))


def parse_stats(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """kind, name, n: section types, reference types and totals of a parsed document."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("section").alias("kind"), F.col("type").alias("name"), "n")
    r = refs.rollup("entity_type").agg(F.count("*").alias("n")).select(F.lit("reference").alias("kind"), F.col("entity_type").alias("name"), "n")
    return n.unionByName(r)
