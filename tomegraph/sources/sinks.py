"""Tables and exports out of the engine (SNK-1..9).

graph_json makes a row a document, for many small ones. A document of any size is written by write_document and its three
forms: lines in part files that, one after the other, are the document.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ranks
from ..session import materialise, remove


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, body: one JSON document a graph, nodes and edges in their order."""
    listed = lambda df, name: df.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in df.columns if c not in ("ord", "graph_id"))))).alias(name))
    both = listed(nodes, "nodes").join(listed(edges, "edges"), "graph_id", "left")
    drop = lambda name, df: F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in df.columns if c not in ("ord", "graph_id"))))
    return both.select("graph_id", F.to_json(F.struct(drop("nodes", nodes).alias("nodes"), F.coalesce(drop("edges", edges), F.array()).alias("edges"))).alias("body"))


#: Lists the part files of a written document in their order; it is there once they are whole.
MANIFEST = "_parts.json"


def write_document(spark: SparkSession, path: str, pieces: Sequence[str | DataFrame]) -> list[dict]:
    """One JSON document in part files; their names and bytes in order, as MANIFEST in the folder lists them.

    A piece is a text, or a frame that orderBy() sorted with an element a row in body: elements get a comma
    before them, but for the first. No row, task or driver holds more than a range of the elements. A
    line holds no line break, as JSON escapes them. A frame without rows gives nothing, so `[` and `]` around it an empty list.
    """
    comma = F.when(F.col("place") == 1, "").otherwise(",")
    listed = lambda df: ranks.numbered(df.select("body"), "place").select("place", F.concat(comma, "body").alias("line"))
    return _write_lines(spark, path, [p if isinstance(p, str) else listed(p) for p in pieces])


def _write_lines(spark: SparkSession, path: str, pieces: Sequence[str | DataFrame]) -> list[dict]:
    """Texts and frames (place, line) below each other, in part files of ordered lines."""
    lines = None
    for i, piece in enumerate(pieces):
        rows = spark.createDataFrame([(0, piece)], "place long, line string") if isinstance(piece, str) else piece
        rows = rows.select(F.lit(i).alias("piece"), "place", "line")
        lines = rows if lines is None else lines.unionByName(rows)
    lines.orderBy("piece", "place").select("line").write.mode("overwrite").text(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder)]
    parts = [{"name": n, "bytes": size} for n, size in sorted(found) if n.startswith("part-")]
    out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, MANIFEST), True)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    return parts


def join_document(spark: SparkSession, path: str, target: str) -> int:
    """The parts of a written document, copied one after the other into one file by the driver in small buffers; its bytes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    folder, whole = hadoop.fs.Path(path), hadoop.fs.Path(target)
    fs = folder.getFileSystem(conf)
    listed = fs.open(hadoop.fs.Path(folder, MANIFEST))
    parts = json.loads(jvm.org.apache.commons.io.IOUtils.toString(listed, "UTF-8"))
    listed.close()
    draft = hadoop.fs.Path(f"{target}.part")
    out = whole.getFileSystem(conf).create(draft, True)
    try:
        for p in parts:
            at = hadoop.fs.Path(folder, p["name"])
            if fs.getFileStatus(at).getLen() != p["bytes"]:
                raise ValueError(f"{path}/{p['name']} has not the {p['bytes']} bytes of the manifest")
            lines = fs.open(at)
            hadoop.io.IOUtils.copyBytes(lines, out, 1 << 16, False)
            lines.close()
    finally:
        out.close()
    remove(target)
    if not whole.getFileSystem(conf).rename(draft, whole):
        raise OSError(f"{target} could not be put in place")
    return sum(p["bytes"] for p in parts)


def _element(df: DataFrame, leave: Sequence[str] = ("ord", "graph_id")) -> Column:
    return F.to_json(F.struct(*(c for c in df.columns if c not in leave))).alias("body")


def _json_text(c: str) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> list[dict]:
    """One graph as one document of nodes and edges in their order (ord), of any size."""
    pieces = ['{"nodes":[', nodes.orderBy("ord").select(_element(nodes)), '],"edges":[', edges.orderBy("ord").select(_element(edges)), "]}"]
    return write_document(nodes.sparkSession, path, pieces)


def write_section_map(locations: DataFrame, path: str) -> list[dict]:
    """The map of section to its locations in order (section_id, location_id, ord); a section may hold any share of the rows.

    A section's first row opens its list and closes the one before. Rows without a section are left out.
    """
    rows = locations.where("section_id IS NOT NULL").select("section_id", "ord", "location_id")
    placed = materialise(ranks.numbered(rows.orderBy("section_id", "ord", "location_id"), "place"), "placed")
    opens = placed.groupBy("section_id").agg(F.min("place").alias("_opens"))
    first = F.col("place") == F.col("_opens")
    value = _json_text("location_id")
    opening = F.concat(F.when(F.col("place") == 1, "").otherwise("],"), _json_text("section_id"), F.lit(":["))
    line = F.concat(F.when(first, opening).otherwise(","), value)
    lines = placed.join(opens, "section_id").select("place", line.alias("line"))
    spark = locations.sparkSession
    return _write_lines(spark, path, ["{", lines, "}" if placed.isEmpty() else "]}"])


def write_vertices(vertices: DataFrame, description: str, source_file: str, path: str) -> list[dict]:
    """graph-like document of vertices by id, with counts by kind in its meta part, of any size."""
    counts = {r.label: r.n for r in vertices.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a kind
    meta = {"stats": dict(sorted(counts.items(), key=lambda x: (x[0] is not None, x[0]))), "description": description, "source_file": source_file}
    order = ("id", "label", "name", "source", "attributes")
    nodes = vertices.orderBy(*order).select(F.to_json(F.struct(*order)).alias("body"))
    return write_document(vertices.sparkSession, path, [f'{{"meta":{json.dumps(meta, ensure_ascii=False)},"nodes":[', nodes, "]}"])


def write_text(df: DataFrame, path: str) -> None:
    """The body column as text files."""
    df.select("body").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def debug_snapshot(df: DataFrame, folder: str, phase: str, enabled: bool = True) -> None:
    if enabled:
        write_table(df, f"{folder}/debug_{phase}")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises if a key has several rows: the constraint of a keyed store."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{', '.join(keys)} not unique: {[tuple(r[:-1]) for r in bad]}")


def upsert_graph(base: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], clear: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Nodes by id, then edges by (source, relation, target) whose ends exist; the counts of what came in."""
    nodes = new[0] if clear else graph.upsert(base[0], new[0], ["id"])
    coming = graph.induced(nodes, new[1])
    edges = coming if clear else graph.upsert(base[1], coming, ["source", "relation", "target"])
    return graph.last_wins(nodes, ["id"]), graph.last_wins(edges, ["source", "relation", "target"]), {"nodes": new[0].count(), "edges": coming.count()}


def delete_all(nodes: DataFrame, edges: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    if not confirm:
        raise ValueError("delete_all asks for confirm=True")
    return nodes.limit(0), edges.limit(0)


def delete_by_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return graph.delete(nodes, edges, nodes.where(F.col("type") == label).select("id"))


def network_html(nodes: list[dict], edges: list[dict], title: str = "graph") -> str:
    """A page that lists a drawn view's data for a viewer script; for views that were sampled to a display size."""
    import html
    import json

    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><script type='application/json' id='graph'>{data}</script>"
