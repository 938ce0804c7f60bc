"""Views of a graph for display (VIEW-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, paths, stats

#: Prefixes that combined graphs put before ids.
PREFIXES = ("location:", "creature:", "item:", "spell:", "party:")


def by_types(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(T.title_case(F.col("type")).isin(*types))
    return kept, graph.induced(kept, edges)


def by_filters(nodes: DataFrame, edges: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Named filters joined by OR: creature, location, item, group, event."""
    test = F.lit(False)
    for name in names:
        test = test | (F.col("node_type") == "event" if name == "event" else F.lower("type") == name)
    kept = nodes.where(test)
    return kept, graph.induced(kept, edges)


def highlighted(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = (), focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with `dim`; a focus overrides the types, an edge is dim if an end is."""
    if focus is not None:
        near = paths.focus(edges, focus).withColumn("_near", F.lit(True))
        marked = nodes.join(near, "id", "left").withColumn("dim", F.col("_near").isNull()).drop("_near")
    else:
        marked = nodes.withColumn("dim", ~T.title_case(F.col("type")).isin(*types) if types else F.lit(False))
    flag = marked.select("id", "dim")
    out = edges
    for end in ("source", "target"):
        out = out.join(flag.select(F.col("id").alias(end), F.col("dim").alias(f"_{end}")), end, "left")
    return marked, out.withColumn("dim", F.coalesce("_source", F.lit(False)) | F.coalesce("_target", F.lit(False))).drop("_source", "_target")


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and one of type Unknown for each dangling end."""
    extra = graph.dangling(nodes, edges).select("id", F.col("id").alias("label"), F.lit("Unknown").alias("type"))
    return nodes.select("id", "label", "type").unionByName(extra)


def drawn(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, size, colour, display_label, tooltip of each node."""
    n = nodes.join(stats.degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    label = F.coalesce(F.when(~T.is_blank(F.col("label")), F.col("label")), F.col("id"))
    size = T.node_size(F.col("degree"))
    tip = F.concat(T.html_escape(label), F.lit("\n["), T.html_escape(T.title_case(F.col("type"))), F.lit("]"))
    return n.select("id", "degree", size.alias("size"), T.node_colour(F.col("type")).alias("colour"), T.display_label(label, size).alias("display_label"), tip.alias("tooltip"))


def filter_types(nodes: DataFrame) -> DataFrame:
    return nodes.select(T.title_case(F.col("type")).alias("type")).distinct().orderBy("type")


def unprefixed(node_id):
    return F.regexp_replace(node_id, "^(" + "|".join(PREFIXES) + ")", "")


def combined(base: tuple[DataFrame, DataFrame], extra: tuple[DataFrame, DataFrame], max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of a location and an entity graph, ids reconciled without prefixes.

    Beyond max_nodes only the entity graph's nodes and those its edges touch are kept.
    """
    strip = lambda n: n.withColumn("id", unprefixed(F.col("id")))
    strip_e = lambda e: e.withColumns({"source": unprefixed(F.col("source")), "target": unprefixed(F.col("target"))})
    nodes = graph.add_missing(strip(base[0]), strip(extra[0]), ["id"])
    edges = graph.unique_edges(graph.stacked([strip_e(base[1]), strip_e(extra[1])]))
    if max_nodes is not None and nodes.count() > max_nodes:
        ids = strip(extra[0]).select("id").union(strip_e(extra[1]).select(F.explode(F.array("source", "target")))).distinct()
        nodes = nodes.join(ids, "id", "left_semi")
        edges = graph.induced(nodes, edges)
    return nodes, edges


#: Presets of exports, the types shown and the most nodes.
PRESETS = {"locations": (("Location",), None), "creatures": (("Creature", "Location"), 150), "combined": (None, 200)}


def preset(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    types, most = PRESETS[name]
    if types is not None:
        nodes, edges = by_types(nodes, edges, types)
    return graph.sample(nodes, edges, most) if most else (nodes, edges)


def capped(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by ord: a display limit."""
    return df.orderBy("ord").limit(n)
