"""Node and edge tables: de-duplication, merging, remapping, induced parts (WIN-1..5, 8, SET-*, JOIN-3..5, 13, GRA-1..3).

De-duplication is an aggregate over a struct (min_by, max_by), not a window: it combines before the
shuffle, so a key that holds a large part of the rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ("source", "target", "relation")


def _pick(df: DataFrame, keys: Sequence[str], order: Column, last: bool, also: Sequence[Column] = ()) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    take = (F.max_by if last else F.min_by)(F.struct(*rest), order).alias("_r")
    out = df.groupBy(*keys).agg(take, *also)
    return out.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), *(c for c in out.columns if c not in keys and c != "_r"))


def first_wins(df: DataFrame, keys: Sequence[str], ord: str = "ord") -> DataFrame:
    return _pick(df, keys, F.col(ord), last=False)


def last_wins(df: DataFrame, keys: Sequence[str], ord: str = "ord", keep_first_position: bool = False) -> DataFrame:
    """The last record of each key; its position is the first one's on request."""
    if not keep_first_position:
        return _pick(df, keys, F.col(ord), last=True)
    out = _pick(df, keys, F.col(ord), last=True, also=[F.min(ord).alias("_first")])
    return out.withColumn(ord, F.col("_first")).drop("_first")


def longest_label(nodes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Whole record of the longest label, the first of equals; position of the first record."""
    best = F.struct(F.length("label"), -F.col("ord"))
    out = _pick(nodes, keys, best, last=True, also=[F.min("ord").alias("_first")])
    return out.withColumn("ord", F.col("_first")).drop("_first")


def upgraded_label(nodes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """First record, with the longest label (the first of equals)."""
    label = F.max_by("label", F.struct(F.length("label"), -F.col("ord"))).alias("_label")
    out = _pick(nodes, keys, F.col("ord"), last=False, also=[label])
    return out.withColumn("label", F.col("_label")).drop("_label")


def unique_edges(edges: DataFrame, key: Sequence[str] = EDGE_KEY) -> DataFrame:
    return first_wins(edges, key)


def deduplicate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return longest_label(nodes), unique_edges(edges)


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables in order; ord becomes (part, ord) as one number."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("ord", F.lit(i << 40) + F.col("ord"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def merge(graphs: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    return deduplicate(stacked([n for n, _ in graphs]), stacked([e for _, e in graphs]))


def add_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base, then the rows of new whose key it lacks (the first of each)."""
    return first_wins(stacked([base, new]), keys)


def only_new(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_wins(new.join(base.select(*keys).distinct(), list(keys), "left_anti"), keys)


def mapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """column through mapping (old_id, new_id), one hop; ids without an entry stay."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(df.columns)


def mapped_array(df: DataFrame, column: str, mapping: DataFrame, key: Sequence[str]) -> DataFrame:
    """Array elements through mapping, in their order."""
    m = mapping.select(F.col("old_id").alias("_x"), F.col("new_id").alias("_new"))
    parts = df.select(*key, F.posexplode(column).alias("_i", "_x")).join(m, "_x", "left")
    again = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_new", "_x").alias("v")))).alias("_a"))
    empty = F.when(F.col(column).isNull(), F.col(column)).otherwise(F.array().cast(df.schema[column].dataType))
    out = df.join(again, list(key), "left")
    return out.withColumn(column, F.coalesce(F.transform("_a", lambda s: s["v"]), empty)).select(df.columns)


def transitive(mapping: DataFrame) -> DataFrame:
    """mapping followed to its end; ids in a cycle, or before one, map to the cycle's smallest id."""
    from .chains import ends

    out = ends(mapping.select(F.col("old_id").alias("id"), F.col("new_id").alias("parent"))).select(F.col("id").alias("old_id"), F.col("root").alias("new_id"))
    still = mapping.where("old_id = new_id").select("old_id", "new_id").join(out, "old_id", "left_anti").distinct()
    return out.unionByName(still)


def remap(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, keep_desc: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ids replaced, self loops dropped, nodes and edges de-duplicated."""
    moved = mapped(mapped(edges, "source", mapping), "target", mapping).where("source <> target")
    if not keep_desc and "desc" in moved.columns:
        moved = moved.drop("desc")
    return longest_label(mapped(nodes, "id", mapping)), unique_edges(moved)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(edges.columns)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of edge ends that are no node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id IS NOT NULL").distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_label and target_label, the id where a node or its label is missing."""
    names = nodes.select("id", "label")
    out = edges
    for end in ("source", "target"):
        n = names.select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))
        out = out.join(n, end, "left").withColumn(f"{end}_label", F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out


def first_n(df: DataFrame, keys: Sequence[str], n: int, ord: str = "ord") -> DataFrame:
    """The n first rows of each key, with their rank; row_number is pushed into the sort as a group limit."""
    from pyspark.sql.window import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ord))).where(F.col("rank") <= n)


def within_chars(df: DataFrame, column: str, limit: int, keys: Sequence[str] = (), ord: str = "ord") -> DataFrame:
    """Rows in order while the running length of column stays within the limit, by keys if given."""
    from pyspark.sql.window import Window

    from .ranks import running

    length = F.coalesce(F.length(column), F.lit(0))
    if not keys:
        return running(df.orderBy(ord), length, "_total").where(F.col("_total") <= limit).drop("_total")
    total = F.sum(length).over(Window.partitionBy(*keys).orderBy(ord).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_total", total).where(F.col("_total") <= limit).drop("_total")


def sample(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n first nodes and the edges among them."""
    some = nodes.orderBy("ord").limit(n)
    return some, induced(some, edges)


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source") == node_id) | (F.col("target") == node_id))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed upsert: rows of new replace those of base (SNK-6, SNK-7 after induced())."""
    return last_wins(stacked([base, new]), keys)


def delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in gone (id) and their edges removed."""
    g = gone.select("id").distinct()
    left = edges
    for end in ("source", "target"):
        left = left.join(g.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(g, "id", "left_anti"), left.select(edges.columns)
