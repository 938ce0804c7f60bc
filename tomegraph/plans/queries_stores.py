"""Queries on keyed tables, exports in parts, distance labels and growing components, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import landmarks, metrics, ranks
from ..session import materialise, scratch_root
from ..sources import sinks
from ..sources.keyed import KeyedTable
from .queries import _id, _t, query


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, path: str) -> DataFrame:
    """line of a document in parts, with its place in the whole."""
    t = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return ranks.numbered(t.orderBy("file", "block", "id"), "place").select("line", "place")


# --- keyed tables -------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT 'c' || c_custkey AS id, CASE WHEN k IS NULL THEN c_name ELSE 'order ' || k END AS label, coalesce(k, 0) AS ord FROM customer LEFT JOIN k ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'n' || n_nationkey, n_name, -1 FROM nation""")
def keyed_batches(spark, d):
    """Customers, then their orders over them (the latest stays), a replay of the first batch, nations, and a delete."""
    c, o, n = (_t(spark, d, x) for x in ("customer", "orders", "nation"))
    table = KeyedTable(spark, _folder(spark, "keyed"), ["id"], rows_per_file=100_000)
    first = c.select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit(0).cast("long").alias("ord"))
    table.upsert(first, "ord", ("batches", 0))
    table.upsert(o.select(_id("c", "o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("label"), F.col("o_orderkey").cast("long").alias("ord")), "ord", ("batches", 1))
    table.upsert(first, "ord", ("batches", 0))
    table.upsert(n.select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(-1).cast("long").alias("ord")), "ord", ("batches", 2))
    table.delete(c.where("c_custkey % 7 = 0").select(_id("c", "c_custkey").alias("id")))
    return table.read()


@query("""
SELECT DISTINCT 'c' || c_custkey AS id, c_name AS label FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def keyed_lookup(spark, d):
    """The rows of given keys, read from the files whose ranges they fall into."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    table = KeyedTable(spark, _folder(spark, "keyed"), ["id"], rows_per_file=100_000)
    table.upsert(c.select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label")))
    return table.lookup(o.where("o_orderstatus = 'P'").select(_id("c", "o_custkey").alias("id")))


# --- exports in parts ---------------------------------------------------------------------------


@query("""
SELECT 'node' AS kind, row_number() OVER (ORDER BY c_custkey) AS place, 'c' || c_custkey AS a, c_name AS b FROM customer
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY o_orderkey), 'c' || o_custkey, 's' || o_orderstatus FROM orders""")
def graph_document(spark, d):
    """A graph as one document in parts, read back line by line: elements and their places."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    nodes = c.select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"))
    edges = o.select(_id("c", "o_custkey").alias("source"), F.concat(F.lit("s"), F.col("o_orderstatus")).alias("target"), F.col("o_orderkey").alias("ord"))
    path = _folder(spark, "graph")
    sinks.write_graph(nodes, edges, path)
    lines = _lines(spark, path)
    middle = lines.where(F.col("line") == '],"edges":[').agg(F.min("place").alias("middle"))  # a row
    x = F.from_json(F.regexp_replace("line", "^,", ""), "id string, label string, source string, target string")
    rows = lines.join(F.broadcast(middle)).where(~F.col("line").isin('{"nodes":[', '],"edges":[', "]}")).withColumn("x", x)
    edge = F.col("place") > F.col("middle")
    return rows.select(F.when(edge, "edge").otherwise("node").alias("kind"), F.when(edge, F.col("place") - F.col("middle")).otherwise(F.col("place") - 1).alias("place"), F.coalesce("x.id", "x.source").alias("a"), F.coalesce("x.label", "x.target").alias("b"))


@query("SELECT count(*) AS n, 'Item' AS label, max(p_partkey) AS biggest FROM part")
def vertex_export(spark, d):
    v = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.lit("Item").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.lit("{}").alias("attributes"))
    path = _folder(spark, "vertices")
    sinks.write_vertices(v, "parts", "part.json", path)
    t = spark.read.text(path)
    n = F.get_json_object(F.concat("value", F.lit("]}")), "$.meta.stats.Item").cast("long")
    key = F.substring(F.get_json_object(F.regexp_replace("value", "^,", ""), "$.id"), 2, 20).cast("long")
    return t.select(n.alias("n"), key.alias("key")).agg(F.max("n").alias("n"), F.lit("Item").alias("label"), F.max("key").alias("biggest"))


@query("SELECT c_mktsegment AS section_id, string_agg('n' || k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT c_mktsegment, c_nationkey AS k FROM customer) GROUP BY 1")
def section_map(spark, d):
    """The map of segments to nations, joined from its parts; it is as long as there are pairs of both."""
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("section_id"), _id("n", "c_nationkey").alias("location_id"), F.col("c_nationkey").alias("ord")).distinct()
    path = _folder(spark, "sections")
    sinks.write_section_map(rows, path)
    sinks.join_document(spark, path, f"{path}.json")
    out = spark.read.text(f"{path}.json", wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("section_id", "v"))
    return out.select("section_id", F.array_join("v", ",").alias("ids"))


# --- distance labels and growing components -----------------------------------------------------


def _trade_places(spark, d) -> DataFrame:
    """Regions, nations, customers with their segments, and suppliers as one undirected graph."""
    n, c, s = (_t(spark, d, x) for x in ("nation", "customer", "supplier"))
    edge = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    out = edge(n, _id("r", "n_regionkey"), _id("n", "n_nationkey")).unionByName(edge(c, _id("n", "c_nationkey"), _id("c", "c_custkey")))
    return out.unionByName(edge(c, _id("m", "c_mktsegment"), _id("c", "c_custkey"))).unionByName(edge(s, _id("s", "s_suppkey"), _id("n", "s_nationkey")))


_FAR = """
WITH p AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS m FROM customer),
x AS (SELECT s, c, CASE WHEN s_nationkey = c_nationkey THEN 2 WHEN a.n_regionkey = b.n_regionkey OR t.k IS NOT NULL THEN 4 END AS d
FROM p JOIN supplier ON s_suppkey = s JOIN customer ON c_custkey = c JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey LEFT JOIN t ON t.k = s_nationkey AND t.m = c_mktsegment)
"""


def _sold(spark, d) -> DataFrame:
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(_id("s", "l_suppkey").alias("start"), _id("c", "o_custkey").alias("end"))


@query(_FAR + "SELECT 's' || s AS start, 'c' || c AS \"end\", d FROM x WHERE d IS NOT NULL")
def label_distances(spark, d):
    """How far customers are from their suppliers, within 5 steps, by labels."""
    return landmarks.distances(landmarks.labels(_trade_places(spark, d), 5, undirected=True), _sold(spark, d), 5)


@query(_FAR + "SELECT 's' || s AS start, 'c' || c AS \"end\", d, d + 1 AS nodes, true AS linked FROM x WHERE d IS NOT NULL")
def label_routes(spark, d):
    """A shortest path of each such pair, with whether every step of it is a link."""
    e = _trade_places(spark, d)
    links = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    routes = materialise(landmarks.routes(landmarks.labels(e, 5, undirected=True), _sold(spark, d), 5), "routes")
    step = F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("source"), F.slice("path", F.lit(2), F.size("path") - 1).alias("target")))
    # steps are shared by many paths: each is looked up once, and what isn't a link goes back to the paths that have it
    astray = materialise(routes.select(step.alias("x")).select("x.*").distinct().join(links, ["source", "target"], "left_anti"), "astray")
    broken = materialise(routes.select("start", "end", step.alias("x")).select("start", "end", "x.*").join(landmarks.small(astray), ["source", "target"]).select("start", "end").distinct(), "broken")
    held = routes.join(landmarks.small(broken.withColumn("broken", F.lit(True))), ["start", "end"], "left")
    return held.select("start", "end", "d", F.size("path").alias("nodes"), (F.col("broken").isNull() & (F.size("path") == F.col("d") + 1)).alias("linked"))


@query("""
WITH g AS (SELECT n_nationkey AS n, CASE WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS g FROM nation),
m AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN g END AS g FROM customer LEFT JOIN g ON n = c_nationkey UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN g END FROM supplier LEFT JOIN g ON n = s_nationkey
UNION ALL SELECT 'n' || n, g FROM g UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'r' || r_regionkey END FROM region),
k AS (SELECT g, min(id) AS component FROM m WHERE g IS NOT NULL GROUP BY g)
SELECT id, coalesce(component, id) AS component FROM m LEFT JOIN k ON m.g = k.g""")
def components_in_batches(spark, d):
    """Customers and nations first, then suppliers, then regions that bring nations together."""
    c, s, n, r = (_t(spark, d, x) for x in ("customer", "supplier", "nation", "region"))
    ids = lambda df, p, k: df.select(_id(p, k).alias("id"))
    edge = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    labels = metrics.components(ids(c, "c", "c_custkey").unionByName(ids(n, "n", "n_nationkey")), edge(c.where("c_acctbal > 0"), _id("c", "c_custkey"), _id("n", "c_nationkey")))
    labels = metrics.grown_components(labels, ids(s, "s", "s_suppkey"), edge(s.where("s_acctbal > 0"), _id("s", "s_suppkey"), _id("n", "s_nationkey")))
    return metrics.grown_components(metrics.materialise(labels, "grown"), ids(r, "r", "r_regionkey"), edge(n.where("n_regionkey % 2 = 0"), _id("n", "n_nationkey"), _id("r", "n_regionkey")))
