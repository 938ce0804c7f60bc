"""The operators as queries over the TPC-H-like tables, each with the SQL that gives the same rows.

Tables stand in for a graph's parts: regions, nations, customers, suppliers and parts are entities,
orders and line items relations, events event nodes, documents and conversations sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import containment, similarity, tags
from ..functions import text as T
from ..operators import canonical, evaluate, flatten, graph, hetero, metrics, parsers, paths, resolve, search, stats, traverse, vector_index, views
from ..session import scratch_root
from ..sources import graphs, sinks
from . import context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


# --- shared inputs ------------------------------------------------------------------------------


def _line_ord(flag: str, values: str):
    """Order number, line number, then the flag: lines that share the first two differ in the flag or not at all."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 4 + F.instr(F.lit(values), F.col(flag))


def _supply_edges(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select(_id("p", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("desc"), _line_ord("l_linestatus", "FO").alias("ord"))


SUPPLY = "SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_returnflag AS relation, l_linestatus AS \"desc\", (l_orderkey * 10 + l_linenumber) * 4 + strpos('FO', l_linestatus) AS ord FROM lineitem"


def _place_edges(spark, d) -> DataFrame:
    n, c = _t(spark, d, "nation"), _t(spark, d, "customer")
    up = n.select(_id("r", "n_regionkey").alias("source"), _id("n", "n_nationkey").alias("target"), F.lit("has_nation").alias("relation"))
    return up.unionByName(c.select(_id("n", "c_nationkey").alias("source"), _id("c", "c_custkey").alias("target"), F.lit("has_customer").alias("relation")))


PLACES = "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'has_nation' AS relation FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_customer' FROM customer"


def _nation_nodes(spark, d) -> DataFrame:
    n, c = _t(spark, d, "nation"), _t(spark, d, "customer")
    a = n.select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), F.col("n_nationkey").cast("long").alias("ord"))
    return a.unionByName(c.select(_id("n", "c_nationkey").alias("id"), F.col("c_name").alias("label"), F.lower("c_mktsegment").alias("type"), (F.col("c_custkey") + 1000).alias("ord")))


NATION_NODES = "SELECT 'n' || n_nationkey AS id, n_name AS label, 'nation' AS type, n_nationkey::BIGINT AS ord FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, lower(c_mktsegment), c_custkey + 1000 FROM customer"


def _brand_nodes(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.col("p_partkey").alias("ord"))


def _events(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(_id("e", "event_id").alias("id"), F.col("event_type").alias("label"), F.col("event_type").alias("type"), F.array(_id("u", "user_id")).alias("participants"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("location"), F.lit("").alias("description"), F.col("event_id").alias("ord"))


# --- retrieval ----------------------------------------------------------------------------------

FLAGSHIP = """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 0), 6) AS score FROM embeddings e, q WHERE vec_id <> 0 AND vec_id IN (SELECT doc_id FROM documents)),
h AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id DESC) AS seed FROM s),
k AS (SELECT d.doc_id, d.source, d.lang, h.seed FROM h JOIN documents d ON d.doc_id = h.vec_id WHERE h.seed <= 3),
e AS (SELECT seed, 'doc:' || doc_id AS a, 'part_of' AS r, 'src:' || source AS b, '- Doc ' || doc_id || ' --[part_of]--> ' || source AS line FROM k
 UNION ALL SELECT seed, 'doc:' || doc_id, 'written_in', 'lang:' || lang, '- Doc ' || doc_id || ' --[written_in]--> ' || lang FROM k
 UNION ALL SELECT seed, 'src:' || source, 'covers', 'lang:' || lang, '- ' || source || ' --[covers]--> ' || lang FROM k)
SELECT min(seed)::INT AS seed_rank, a AS source_id, r AS relationship, b AS target_id, line FROM e GROUP BY a, r, b, line"""


@query(FLAGSHIP)
def flagship_context(spark, d):
    return context.flagship(_t(spark, d, "documents"), _t(spark, d, "embeddings"))


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 0), 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id DESC LIMIT 10""")
def vector_topk_nodes(spark, d):
    e = _t(spark, d, "embeddings")
    q = list(e.where("vec_id = 0").first().embedding)
    return search.top_k(e, q, 10, ord="vec_id").select("vec_id", "score")


_TOPK = """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM p)
SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 3"""


@query(_TOPK)
def vector_topk_per_query(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.top_k_per_query(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 3)


def _indexed(spark, d, exact: bool) -> DataFrame:
    """Search in an index of all embeddings, written first and opened anew."""
    import uuid

    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = f"{scratch_root(spark)}/vector-index-{uuid.uuid4().hex}"
    vector_index.VectorIndex.build(e, path)
    return vector_index.VectorIndex.open(spark, path).search(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 3, exact=exact)


@query(_TOPK)
def vector_index_exact(spark, d):
    """All true neighbours, from the cells that can hold them."""
    return _indexed(spark, d, True)


@query()
def vector_index_topk(spark, d):
    """Neighbours from the cells that a query looks into; recall is held by a test."""
    return _indexed(spark, d, False)


# --- nodes and edges ----------------------------------------------------------------------------


@query(f"SELECT id, arg_max(label, ord) AS label, arg_max(type, ord) AS type, min(ord) AS ord FROM ({NATION_NODES}) GROUP BY id")
def graph_nodes_last_wins(spark, d):
    return graph.last_wins(_nation_nodes(spark, d), ["id"], keep_first_position=True)


@query("SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def graph_implicit_nodes(spark, d):
    nodes = _t(spark, d, "customer").where("c_acctbal > 0").select(_id("c", "c_custkey").alias("id"))
    edges = _t(spark, d, "orders").select(_id("c", "o_custkey").alias("source"), _id("c", "o_custkey").alias("target"))
    return graph.dangling(nodes, edges)


@query("""
WITH k AS (SELECT 'c' || c_custkey AS id, c_name AS label, 'Customer' AS type FROM customer WHERE c_acctbal > 0)
SELECT * FROM k UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey, 'Unknown' FROM orders WHERE 'c' || o_custkey NOT IN (SELECT id FROM k)""")
def placeholder_nodes(spark, d):
    nodes = _t(spark, d, "customer").where("c_acctbal > 0").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("Customer").alias("type"))
    edges = _t(spark, d, "orders").select(_id("c", "o_custkey").alias("source"), _id("c", "o_custkey").alias("target"))
    return views.with_placeholders(nodes, edges)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS k, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part)
SELECT p_brand AS id, p_name AS label, p_type AS type, first AS ord FROM r WHERE k = 1""")
def nodes_keep_longest_label(spark, d):
    return graph.longest_label(_brand_nodes(spark, d))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part)
SELECT a.p_brand AS id, a.p_name AS label, b.p_type AS type, b.p_partkey AS ord FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.k = 1 AND b.f = 1""")
def nodes_label_upgrade(spark, d):
    return graph.upgraded_label(_brand_nodes(spark, d))


@query(f'SELECT source, target, relation, arg_min("desc", ord) AS "desc", min(ord) AS ord FROM ({SUPPLY}) GROUP BY source, target, relation')
def edges_first_wins(spark, d):
    return graph.unique_edges(_supply_edges(spark, d))


def _trade(spark, d) -> DataFrame:
    li, o, c, s = (_t(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(_id("n", "s_nationkey").alias("source"), _id("n", "c_nationkey").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


TRADE = "SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"""
WITH m AS (SELECT 'n' || n_nationkey AS o, 'r' || n_regionkey AS n FROM nation)
SELECT a.n AS source, b.n AS target, relation, min(ord) AS ord FROM ({TRADE}) e JOIN m a ON e.source = a.o JOIN m b ON e.target = b.o WHERE a.n <> b.n GROUP BY a.n, b.n, relation""")
def remap_drop_self_loops(spark, d):
    n = _t(spark, d, "nation")
    mapping = n.select(_id("n", "n_nationkey").alias("old_id"), _id("r", "n_regionkey").alias("new_id"))
    nodes = n.select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    return graph.remap(nodes, _trade(spark, d), mapping)[1]


@query("""
WITH m AS (SELECT 'n' || n_nationkey AS o, 'r' || n_regionkey AS n FROM nation),
x AS (SELECT m.n AS id, n_name AS label, n_nationkey AS ord FROM nation JOIN m ON m.o = 'n' || n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(label) DESC, ord) AS k, min(ord) OVER (PARTITION BY id) AS f FROM x)
SELECT id, label, f AS ord FROM r WHERE k = 1""")
def remap_nodes(spark, d):
    n = _t(spark, d, "nation")
    mapping = n.select(_id("n", "n_nationkey").alias("old_id"), _id("r", "n_regionkey").alias("new_id"))
    nodes = n.select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    return graph.remap(nodes, _trade(spark, d), mapping)[0]


@query("""
WITH e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_shipdate < TIMESTAMP '1995-01-01' AS old, l_returnflag AS relation, (l_orderkey * 10 + l_linenumber) * 4 + strpos('ANR', l_returnflag) AS ord FROM lineitem)
SELECT source, target, CASE WHEN bool_or(old) THEN 'base' ELSE 'new' END AS origin, coalesce(arg_min(relation, ord) FILTER (WHERE old), arg_min(relation, ord)) AS relation FROM e GROUP BY source, target""")
def incremental_edge_merge(spark, d):
    e = _t(spark, d, "lineitem").select(_id("p", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), _line_ord("l_returnflag", "ANR").alias("ord"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("old"))
    base, new = e.where("old").withColumn("origin", F.lit("base")), e.where("NOT old").withColumn("origin", F.lit("new"))
    return graph.add_missing(base, new, ["source", "target"]).select("source", "target", "origin", "relation")


@query("""
WITH e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_shipdate < TIMESTAMP '1995-01-01' AS old, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT source, target, min(ord) AS ord FROM e GROUP BY source, target HAVING NOT bool_or(old)""")
def only_new_edges(spark, d):
    e = _t(spark, d, "lineitem").select(_id("p", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("old"))
    return graph.only_new(e.where("old").drop("old"), e.where("NOT old").drop("old"), ["source", "target"])


@query(f"""
WITH k AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 25)
SELECT e.* FROM ({SUPPLY}) e WHERE source IN (SELECT id FROM k)""")
def induced_subgraph(spark, d):
    p = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("type"))
    s = _t(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id"), F.lit("supplier").alias("type"))
    return views.by_types(p.unionByName(s), _supply_edges(spark, d), ["Large", "Supplier"])[1]


@query(f"SELECT e.source, e.target, relation, ord, p_name AS source_label, s_name AS target_label FROM ({SUPPLY}) e JOIN part ON source = 'p' || p_partkey JOIN supplier ON target = 's' || s_suppkey")
def edge_labels(spark, d):
    p = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("label"))
    s = _t(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return graph.labelled(_supply_edges(spark, d).drop("desc"), p.unionByName(s)).select("source", "target", "relation", "ord", "source_label", "target_label")


@query("""
SELECT 'e' || event_id AS id, 'm' || (user_id % 7) AS participant, CASE WHEN json_extract_string(props, '$.k')::INT < 5 THEN 'low' ELSE 'k' || json_extract_string(props, '$.k') END AS location FROM events""")
def event_refs_mapped(spark, d):
    e = _events(spark, d)
    users = e.select(F.explode("participants").alias("old_id")).distinct()
    users = users.withColumn("new_id", F.concat(F.lit("m"), F.expr("CAST(substring(old_id, 2) AS BIGINT) % 7")))
    places = e.select(F.col("location").alias("old_id")).distinct().where("CAST(substring(old_id, 2) AS INT) < 5").withColumn("new_id", F.lit("low"))
    out = graph.mapped_array(graph.mapped(e, "location", places), "participants", users, ["id"])
    return out.select("id", F.get("participants", 0).alias("participant"), "location")


@query(f'WITH u AS (SELECT * FROM ({NATION_NODES}) WHERE type = \'nation\' UNION ALL SELECT * FROM ({NATION_NODES}) WHERE type <> \'nation\') SELECT id, arg_max(label, ord) AS label FROM u GROUP BY id')
def keyed_upsert(spark, d):
    n = _nation_nodes(spark, d)
    return graph.upsert(n.where("type = 'nation'"), n.where("type <> 'nation'"), ["id"]).select("id", "label")


@query(f"SELECT source, target, relation FROM ({PLACES}) WHERE target NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_by_label(spark, d):
    c = _t(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    n = _t(spark, d, "nation").select(_id("n", "n_nationkey").alias("id"), F.lit("nation").alias("type"))
    r = _t(spark, d, "region").select(_id("r", "r_regionkey").alias("id"), F.lit("region").alias("type"))
    return sinks.delete_by_label(c.unionByName(n).unionByName(r), _place_edges(spark, d), "BUILDING")[1]


@query("""
WITH e AS (SELECT n_regionkey, n_nationkey, n_name FROM nation)
SELECT 'r' || n_regionkey AS graph_id, 'n' || n_nationkey AS id, n_name AS label, 'nation' AS type FROM e
UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'r' || n_regionkey, NULL, NULL FROM e""")
def graph_json_round_trip(spark, d):
    n = _t(spark, d, "nation")
    gid = _id("r", "n_regionkey")
    nodes = n.select(gid.alias("graph_id"), _id("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), F.col("n_nationkey").cast("long").alias("ord"))
    edges = n.select(gid.alias("graph_id"), gid.alias("source"), _id("n", "n_nationkey").alias("target"), F.lit("has").alias("relation"), F.col("n_nationkey").cast("long").alias("ord"))
    docs = sinks.graph_json(nodes, edges).withColumnRenamed("graph_id", "doc_id")
    return graphs.parse_graphs(docs)[0].select("graph_id", "id", "label", "type")


# --- statistics ---------------------------------------------------------------------------------

DEGREE = f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({SUPPLY}) UNION ALL SELECT target FROM ({SUPPLY})) GROUP BY id"


@query(f"""
WITH g AS ({DEGREE}), x AS (SELECT min(degree) AS lo, max(degree) AS hi FROM g)
SELECT id, degree, round(10 + 40.0 * (degree - lo) / greatest(hi - lo, 1), 6) AS size, CASE WHEN degree >= 20 THEN 'hub' WHEN degree >= 10 THEN 'high' WHEN degree >= 5 THEN 'middle' ELSE 'low' END AS tier FROM g, x""")
def degree_and_size(spark, d):
    out = stats.sized(stats.degrees(_supply_edges(spark, d)))
    return out.select("id", "degree", F.round("size", 6).alias("size"), "tier")


@query(f"""
WITH n AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n_nodes), m AS (SELECT count(*) AS n_edges FROM (SELECT DISTINCT source, target FROM ({SUPPLY})))
SELECT n_nodes, n_edges, round(n_edges / (n_nodes::DOUBLE * (n_nodes - 1)), 9) AS density FROM n, m""")
def graph_density(spark, d):
    nodes = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id")).unionByName(_t(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id")))
    return stats.density(nodes, _supply_edges(spark, d)).withColumn("density", F.round("density", 9))


@query(f"SELECT id, degree FROM ({DEGREE}) ORDER BY degree DESC, id LIMIT 20")
def top_degree_nodes(spark, d):
    return stats.top_degrees(_supply_edges(spark, d), 20)


@query("SELECT upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS type, count(*) AS n FROM events GROUP BY 1")
def type_histogram(spark, d):
    return stats.type_histogram(_t(spark, d, "events"), "event_type")


@query(f"""
SELECT 'node' AS kind, type AS name, count(*) AS n FROM (SELECT event_type AS type FROM events) GROUP BY ROLLUP (type)
UNION ALL SELECT 'edge', relation, count(*) FROM ({SUPPLY}) GROUP BY ROLLUP (relation)""")
def graph_totals(spark, d):
    return stats.graph_totals(_t(spark, d, "events").select(F.col("event_type").alias("type")), _supply_edges(spark, d))


@query("""
WITH n AS (SELECT 'event' AS node_type, event_type AS type, NULL::VARCHAR AS subtype, false AS is_generic FROM events UNION ALL SELECT 'entity', 'Item', p_brand, p_size > 25 FROM part)
SELECT node_type, type, subtype, is_generic::VARCHAR AS is_generic, count(*) AS n FROM n GROUP BY GROUPING SETS ((node_type, type), (type, subtype), (type, is_generic), (node_type), ())""")
def graph_stats_grouping_sets(spark, d):
    e = _t(spark, d, "events").select(F.lit("event").alias("node_type"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("subtype"), F.lit(False).alias("is_generic"))
    p = _t(spark, d, "part").select(F.lit("entity").alias("node_type"), F.lit("Item").alias("type"), F.col("p_brand").alias("subtype"), (F.col("p_size") > 25).alias("is_generic"))
    return stats.semantic_stats(e.unionByName(p)).drop("grouping").withColumn("is_generic", F.col("is_generic").cast("string"))


@query(f"""
SELECT source, target, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations, count(*) AS n_edges, count(*) || ' relations' AS "desc" FROM ({SUPPLY}) GROUP BY source, target""")
def parallel_edge_rollup(spark, d):
    return stats.parallel_edges(_supply_edges(spark, d)).select("source", "target", F.array_join("relations", ",").alias("relations"), "n_edges", "desc")


@query(f"SELECT relation, count(*) AS n FROM ({SUPPLY}) GROUP BY relation")
def relation_counts(spark, d):
    return stats.relation_counts(_supply_edges(spark, d))


# --- events -------------------------------------------------------------------------------------

EVENT_EDGES = "SELECT 'e' || event_id AS source, 'u' || user_id AS target, 'has_participant' AS relation, 'Participant in ' || event_type AS \"desc\" FROM events UNION ALL SELECT 'e' || event_id, 'k' || json_extract_string(props, '$.k'), 'occurs_at', event_type || ' at this location' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"


@query(EVENT_EDGES)
def event_edges(spark, d):
    return hetero.event_edges(_events(spark, d))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT a.user_id AS source, b.user_id AS target FROM u a JOIN u b ON b.user_id = a.user_id + 1""")
def entity_only_graph(spark, d):
    e = _events(spark, d)
    users = _t(spark, d, "events").select("user_id").distinct()
    nodes = users.select(F.col("user_id").cast("string").alias("id"), F.lit("entity").alias("node_type")).unionByName(e.select("id", F.lit("event").alias("node_type")))
    edges = users.select(F.col("user_id").cast("string").alias("source"), (F.col("user_id") + 1).cast("string").alias("target")).unionByName(e.select(F.col("id").alias("source"), F.expr("substring(participants[0], 2)").alias("target")))
    return hetero.entity_subgraph(nodes, edges)[1].select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


@query("""
WITH a AS (SELECT DISTINCT event_type, json_extract_string(props, '$.k') AS k FROM events), known AS (SELECT n_nationkey::VARCHAR AS k FROM nation)
SELECT event_type AS section_id, string_agg(k, ',' ORDER BY k) AS location_ids FROM a WHERE k IN (SELECT k FROM known) GROUP BY event_type""")
def section_locations_valid(spark, d):
    e = _t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    answers = e.groupBy(F.col("event_type").alias("section_id")).agg(F.array_sort(F.collect_set("k")).alias("location_ids"))
    known = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return hetero.valid_locations(answers, known).select("section_id", F.array_join("location_ids", ",").alias("location_ids"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
SELECT p_brand AS type, string_agg('[p' || p_partkey || '] ' || p_name || ' (' || p_brand || ')', chr(10) ORDER BY k) AS text, count(*) AS n FROM r WHERE k <= 20 GROUP BY p_brand""")
def known_entities_top20(spark, d):
    p = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("ord"))
    return hetero.known_entities(p)


@query("SELECT key, arg_max(id, ord) AS id FROM (SELECT 'p' || p_partkey AS id, p_partkey AS ord, unnest(['p' || p_partkey, p_name]) AS key FROM part) GROUP BY key")
def entity_lookup(spark, d):
    p = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("ord"))
    return hetero.entity_lookup(p)


# --- paths and metrics --------------------------------------------------------------------------


def _ego(spark, d, radius):
    seeds = spark.createDataFrame([("r0", 1), ("n7", 2)], "id string, seed_ord int")
    return paths.ego_edges(_place_edges(spark, d), seeds, radius)


def _ego_sql(radius: int) -> str:
    return f"""
WITH RECURSIVE e AS ({PLACES}), s(seed, o) AS (VALUES ('r0', 1), ('n7', 2)),
w AS (SELECT seed, o, seed AS id, 0 AS h FROM s UNION ALL SELECT w.seed, w.o, e.target, w.h + 1 FROM w JOIN e ON e.source = w.id WHERE w.h < {radius}),
k AS (SELECT DISTINCT seed, o, id FROM w)
SELECT min(a.o)::INT AS seed_ord, e.source, e.target, e.relation FROM e JOIN k a ON a.id = e.source JOIN k b ON b.id = e.target AND b.seed = a.seed GROUP BY e.source, e.target, e.relation"""


@query(_ego_sql(1))
def ego_1hop(spark, d):
    return _ego(spark, d, 1)


@query(_ego_sql(2))
def ego_2hop(spark, d):
    return _ego(spark, d, 2)


@query(_ego_sql(3))
def ego_3hop(spark, d):
    return _ego(spark, d, 3)


@query("SELECT 'r' || n_regionkey AS start, 'c' || c_custkey AS \"end\", 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def directed_paths_le3(spark, d):
    starts = _t(spark, d, "region").select(_id("r", "r_regionkey").alias("id"))
    ends = _t(spark, d, "customer").select(_id("c", "c_custkey").alias("id"))
    return paths.paths(_place_edges(spark, d), starts, ends, 3).select("start", "end", F.array_join("path", ">").alias("path"))


@query("""
SELECT 'n' || a.n_nationkey AS start, 'n' || b.n_nationkey AS "end", 'n' || a.n_nationkey || '-r' || a.n_regionkey || '-n' || b.n_nationkey AS path FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def undirected_path_le5(spark, d):
    n = _t(spark, d, "nation").select(_id("n", "n_nationkey").alias("id"))
    return paths.paths(_place_edges(spark, d), n, n, 5, undirected=True).select("start", "end", F.array_join("path", "-").alias("path"))


@query(f"SELECT DISTINCT unnest([source, target, 'n7']) AS id FROM ({PLACES}) WHERE source = 'n7' OR target = 'n7'")
def focus_group(spark, d):
    return paths.focus(_place_edges(spark, d), "n7")


@query(f"""
WITH f AS (SELECT DISTINCT unnest([source, target, 'n7']) AS id FROM ({PLACES}) WHERE source = 'n7' OR target = 'n7')
SELECT source, target, source NOT IN (SELECT id FROM f) OR target NOT IN (SELECT id FROM f) AS dim FROM ({PLACES})""")
def highlighted_edges(spark, d):
    e = _place_edges(spark, d)
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("type", F.lit("place"))
    return views.highlighted(nodes, e, focus="n7")[1].select("source", "target", "dim")


@query("""
WITH m AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS g FROM customer UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation),
k AS (SELECT g, min(id) AS component FROM m WHERE g IS NOT NULL GROUP BY g)
SELECT id, coalesce(component, id) AS component FROM m LEFT JOIN k ON m.g = k.g""")
def components(spark, d):
    c, s, n = (_t(spark, d, x) for x in ("customer", "supplier", "nation"))
    nodes = c.select(_id("c", "c_custkey").alias("id")).unionByName(s.select(_id("s", "s_suppkey").alias("id"))).unionByName(n.select(_id("n", "n_nationkey").alias("id")))
    edges = c.where("c_acctbal > 0").select(_id("c", "c_custkey").alias("source"), _id("n", "c_nationkey").alias("target"))
    edges = edges.unionByName(s.where("s_acctbal > 0").select(_id("s", "s_suppkey").alias("source"), _id("n", "s_nationkey").alias("target")))
    return metrics.components(nodes, edges)


@query(f"""
WITH u AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM ({TRADE}) WHERE source <> target),
g AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id),
t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
c AS (SELECT id, count(*) AS triangles FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY id)
SELECT g.id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) END, 6) AS coefficient FROM g LEFT JOIN c ON g.id = c.id""")
def clustering(spark, d):
    return metrics.clustering(_trade(spark, d)).withColumn("coefficient", F.round("coefficient", 6))


# --- texts --------------------------------------------------------------------------------------


def _tagged(spark, d) -> DataFrame:
    li, p, s = (_t(spark, d, x) for x in ("lineitem", "part", "supplier"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    text = F.concat(F.lit("Order of {@item "), F.col("p_name"), F.lit("|"), F.col("p_brand"), F.lit("} from {@creature "), F.col("s_name"), F.lit("} in {@b "), F.col("l_returnflag"), F.lit("}."))
    return j.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("section_id"), text.alias("text"), "p_name", "p_brand", "s_name", "l_returnflag")


TAGGED = "SELECT l_orderkey || ':' || l_linenumber AS section_id, p_name, p_brand, s_name, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT section_id, 'Order of ' || p_name || ' from ' || s_name || ' in ' || l_returnflag || '.' AS clean FROM ({TAGGED})")
def tag_clean_text(spark, d):
    return _tagged(spark, d).select("section_id", tags.clean_text(F.coalesce("text", F.lit(""))).alias("clean"))


@query(f"SELECT section_id, p_name AS text, 'item' AS tag, p_brand AS attrs FROM ({TAGGED}) UNION ALL SELECT section_id, s_name, 'creature', '' FROM ({TAGGED})")
def tag_links(spark, d):
    links = _tagged(spark, d).select("section_id", F.explode(tags.parse_and_clean(F.col("text"))["links"]).alias("l"))
    return links.select("section_id", "l.text", "l.tag", F.array_join("l.attrs", "|").alias("attrs"))


def _refs(spark, d) -> DataFrame:
    links = _tagged(spark, d).select("section_id", F.explode(tags.grouped(tags.parse_and_clean(F.col("text"))["links"], "entity")).alias("l"))
    return links.select("section_id", tags.external_ref(F.col("l")).alias("r")).select("section_id", "r.*")


REFS = f"SELECT section_id, 'item' AS entity_type, p_name || '|' || p_brand AS identifier, p_name AS display_name FROM ({TAGGED}) UNION ALL SELECT section_id, 'creature', s_name, s_name FROM ({TAGGED})"


@query(REFS)
def external_refs(spark, d):
    return _refs(spark, d)


@query(f"SELECT entity_type, identifier, display_name, count(*) AS n_mentions, count(DISTINCT section_id) AS n_sections FROM ({REFS}) GROUP BY 1, 2, 3")
def mention_ranking(spark, d):
    return stats.mention_ranking(_refs(spark, d))


@query(f"SELECT DISTINCT 'item' AS kind, p_name AS name, p_brand AS source FROM ({TAGGED}) UNION ALL SELECT DISTINCT 'creature', s_name, NULL FROM ({TAGGED})")
def tag_reference_set(spark, d):
    return _tagged(spark, d).select(F.explode(tags.tag_references(F.col("text"))).alias("r")).select("r.*").distinct()


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' - ' || p_type), '[ \\-]', '_', 'g'), '[^a-z0-9_]', '', 'g') AS snake_id, regexp_replace(regexp_replace(lower(p_type || ' #' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def snake_ids(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.snake_id(F.concat_ws(" - ", "p_name", "p_type")).alias("snake_id"), T.slug(F.concat_ws(" #", "p_type", "p_brand")).alias("slug"))


@query("SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS name, trim(regexp_replace(lower(replace(c_name || '_' || c_mktsegment, '_', ' ')), '\\s+', ' ', 'g')) AS label FROM customer")
def normalized_names(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", T.normalized_name(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("name"), T.normalized_label(F.concat_ws("_", "c_name", "c_mktsegment")).alias("label"))


@query("SELECT p_partkey, md5(lower('item:' || trim(p_name) || ':' || p_brand)) AS id FROM part")
def md5_ids(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.md5_id("item", F.col("p_name"), F.col("p_brand")).alias("id"))


@query("SELECT DISTINCT o_orderpriority AS relation, CASE WHEN lower(o_orderpriority) IN ('part_of', 'contains') THEN upper(o_orderpriority) ELSE replace(replace(upper(o_orderpriority), ' ', '_'), '-', '_') END AS relation_type FROM orders")
def relation_types(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderpriority").alias("relation"), T.relation_type(F.col("o_orderpriority")).alias("relation_type")).distinct()


@query("""
SELECT id, CASE WHEN regexp_matches(label, '^(zombie|skeleton|goblin|kobold|orc|bandit|guard|cultist|warrior|soldier|merchant|villager|commoner|pirate|sailor|dragon)') OR (label LIKE '%s' AND length(label) > 4) THEN true ELSE false END AS is_generic,
 regexp_matches(id, '^(item|node)_[0-9]+$') AS is_meaningless FROM (SELECT CASE WHEN p_size > 25 THEN 'item_' ELSE 'stone_' END || p_partkey AS id, lower(split_part(p_name, ' ', 1)) || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END AS label FROM part)""")
def generic_and_meaningless(spark, d):
    p = _t(spark, d, "part").select(F.concat(F.when(F.col("p_size") > 25, "item_").otherwise("stone_"), F.col("p_partkey")).alias("id"), F.concat(F.get(F.split("p_name", " "), 0), F.when(F.col("p_size") % 2 == 0, "s").otherwise("")).alias("label"))
    return p.select("id", T.is_generic_creature(F.col("label")).alias("is_generic"), T.is_meaningless(F.col("id"), F.col("label")).alias("is_meaningless"))


NAMES = "SELECT DISTINCT p_name AS name FROM part"


@query(f"""
WITH n AS ({NAMES})
SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::BIGINT AS distance FROM n a JOIN n b ON a.name < b.name
WHERE ((contains(a.name, b.name) OR contains(b.name, a.name)) AND least(length(a.name), length(b.name)) >= 0.5 * greatest(length(a.name), length(b.name))) OR levenshtein(a.name, b.name) <= 2 OR levenshtein(a.name, b.name) <= 0.2 * greatest(length(a.name), length(b.name))""")
def similar_labels(spark, d):
    pairs = canonical.similar_pairs(_t(spark, d, "part").select(F.col("p_name").alias("label")))
    return pairs.select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@query(f"""
WITH n AS ({NAMES}), p AS (SELECT 100.0 * (1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name))) AS s FROM n a JOIN n b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) AND a.name <> b.name)
SELECT CASE WHEN s >= 100 THEN 'exact' WHEN s >= 90 THEN 'high' WHEN s >= 80 THEN 'fair' WHEN s > 0 THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM p GROUP BY 1""")
def match_buckets(spark, d):
    n = _t(spark, d, "part").select("p_name").distinct()
    first = lambda c: F.get(F.split(c, " "), 0)
    a, b = n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b"))
    pairs = a.join(b, (first("a") == first("b")) & (F.col("a") != F.col("b")))
    return pairs.groupBy(evaluate.bucket(similarity.edit_ratio(F.col("a"), F.col("b"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_name AS label, upper(p_name) AS extracted FROM part")
def exact_label_matches(spark, d):
    p = _t(spark, d, "part")
    m = evaluate.exact_matches(p.select(F.col("p_name").alias("name")), p.select(F.upper("p_name").alias("name")))
    return m.select("label", "extracted")


@query("""
WITH c AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name),
k AS (SELECT p_name AS name, p_brand AS source, min(p_partkey) AS ord FROM part GROUP BY 1, 2),
r AS (SELECT s_suppkey AS ref_id, p_name, p_brand, s_suppkey % 3 AS how FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT r.ref_id, CASE WHEN how = 0 THEN 1 WHEN how = 1 THEN 2 ELSE 3 END AS tier, CASE WHEN how = 0 THEN k.ord ELSE c.ord END AS matched_ord FROM r JOIN c ON c.name = r.p_name JOIN k ON k.name = r.p_name AND k.source = r.p_brand""")
def catalog_tiered_lookup(spark, d):
    p, s = _t(spark, d, "part"), _t(spark, d, "supplier")
    catalog = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"))
    j = s.join(p, p.p_partkey == s.s_suppkey)
    how = F.col("s_suppkey") % 3
    refs = j.select(F.col("s_suppkey").alias("ref_id"), F.when(how == 2, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(how == 0, F.col("p_brand")).otherwise("nowhere").alias("source"))
    return resolve.match(refs, catalog, "creature").select("ref_id", "tier", "matched_ord")


@query("""
WITH n AS (SELECT DISTINCT lower(p_name) AS t FROM part), w AS (SELECT DISTINCT split_part(lower(p_name), ' ', 2) AS needle FROM part)
SELECT t AS hay, needle FROM n JOIN w ON needle <> '' AND contains(t, needle)""")
def substring_join(spark, d):
    n = _t(spark, d, "part").select(F.lower("p_name").alias("t")).distinct()
    w = n.select(F.get(F.split("t", " "), 1).alias("needle")).distinct()
    return containment.contained(n.select(F.col("t").alias("hay_id"), F.col("t").alias("hay")), w.select(F.col("needle").alias("needle_id"), "needle")).select("hay", "needle")


@query("""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
a AS (SELECT item_id AS id, array_to_string(w[1 : 2 + item_id % 5], ' ') AS alias FROM w UNION ALL SELECT item_id, w[3] || w[4][1 : 2] FROM w UNION ALL SELECT item_id, substr(w[2], 1, 5) FROM w WHERE length(w[2]) > 5)
SELECT doc_id, count(DISTINCT id) AS n_items, min(id::VARCHAR) AS first_item FROM documents JOIN a ON alias <> '' AND contains(replace(lower(text), '_', ' '), alias) GROUP BY doc_id""")
def alias_mentions(spark, d):
    w = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    runs = w.select("id", F.array_join(F.slice("w", F.lit(1), (2 + F.col("id") % 5).cast("int")), " ").alias("alias"))
    odd = w.select("id", F.concat(F.get("w", 2), F.substring(F.get("w", 3), 1, 2)).alias("alias"))
    heads = w.where(F.length(F.get("w", 1)) > 5).select("id", F.substring(F.get("w", 1), 1, 5).alias("alias"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.col("text").alias("content"))
    m = canonical.mentions(docs, runs.unionByName(odd).unionByName(heads))
    return m.select(F.col("section_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_items"), F.array_min("ids").alias("first_item"))


@query("SELECT doc_id, item_id, (strpos(lower(d.text), lower(b.text)) - 1)::BIGINT AS at FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def label_containment(spark, d):
    terms = _t(spark, d, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return containment.occurrences(docs, terms).select(F.col("id").alias("doc_id"), F.col("term_id").alias("item_id"), "at")


PREDICT = "SELECT lang, (quality = 1 AND p)::INT AS hit, p::INT AS p, quality FROM (SELECT lang, quality, NOT (contains(text, '!!') OR contains(text, '$$$') OR contains(text, ' | ')) AS p FROM labels JOIN documents USING (doc_id))"


def _predicted(spark, d) -> DataFrame:
    good = ~(F.contains("text", F.lit("!!")) | F.contains("text", F.lit("$$$")) | F.contains("text", F.lit(" | ")))
    j = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").withColumn("p", good)
    return j.select("lang", ((F.col("quality") == 1) & F.col("p")).cast("int").alias("hit"), F.col("p").cast("int").alias("p"), "quality")


def _prf(df: DataFrame) -> DataFrame:
    scores = evaluate.prf(F.col("m"), F.col("e"), F.col("l"))
    return df.select(*(c for c in df.columns if c not in "mel"), *(F.round(s, 6).alias(n) for s, n in zip(scores, ("precision", "recall", "f1"), strict=True)))


_PRF_SQL = "round(100.0 * sum(hit) / sum(p), 6) AS precision, round(100.0 * sum(hit) / sum(quality), 6) AS recall, round(200.0 * sum(hit) / (sum(p) + sum(quality)), 6) AS f1"


@query(f"SELECT lang, {_PRF_SQL} FROM ({PREDICT}) GROUP BY lang")
def prf1_by_lang(spark, d):
    return _prf(_predicted(spark, d).groupBy("lang").agg(F.sum("hit").alias("m"), F.sum("p").alias("e"), F.sum("quality").alias("l")))


@query(f"SELECT {_PRF_SQL} FROM ({PREDICT})")
def prf1_overall(spark, d):
    return _prf(_predicted(spark, d).agg(F.sum("hit").alias("m"), F.sum("p").alias("e"), F.sum("quality").alias("l")))


# --- sections -----------------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.array_repeat(F.lit(0), (F.col("turn") + 1).cast("int")).alias("path"), F.when(F.col("turn") > 0, F.array_repeat(F.lit(0), F.col("turn").cast("int"))).otherwise(F.array().cast("array<int>")).alias("parent_path"), F.col("turn").cast("int").alias("depth"), F.col("turn").cast("string").alias("node_id"), F.concat_ws(" ", "role", "turn").alias("title"), F.col("role").alias("type"), F.col("text").alias("content"))


@query("""
SELECT c.conv_id::VARCHAR AS doc_id, c.turn::VARCHAR AS node_id, 'ID: ' || c.turn || chr(10) || 'Parent Title: ' || coalesce(p.role || ' ' || p.turn, 'None') || chr(10) || 'Title: ' || c.role || ' ' || c.turn || chr(10) || 'Content: ' || c.text || chr(10) || 'Child Titles: ' || coalesce(k.role || ' ' || k.turn, 'None') AS block
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations k ON k.conv_id = c.conv_id AND k.turn = c.turn + 1 WHERE trim(c.text) <> ''""")
def section_context(spark, d):
    t = traverse.with_family(_turns(spark, d))
    return t.select("doc_id", "node_id", T.section_block(F.col("node_id"), F.col("parent_title"), F.col("title"), F.col("content"), F.col("child_titles")).alias("block"))


@query("""
WITH l AS (SELECT source AS section, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents WHERE lang <> 'en') GROUP BY source)
SELECT doc_id::VARCHAR AS doc_id, langs FROM documents JOIN l ON section = source WHERE trim(text) <> ''""")
def eligible_sections(spark, d):
    docs = _t(spark, d, "documents")
    sections = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("section_id"), F.col("text").alias("content"), F.array().cast("array<string>").alias("links"))
    places = docs.where("lang <> 'en'").select(F.col("source").alias("section_id"), F.col("lang").alias("location_id")).distinct()
    places = places.withColumn("ord", F.expr("array_position(array('de', 'es', 'fr'), location_id)"))
    return hetero.eligible_sections(sections, places).select("doc_id", F.array_join("location_ids", ",").alias("langs"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '... [truncated]' ELSE text END AS text FROM documents")
def truncate_budget(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 2000).alias("text"))


@query("""
WITH n AS (SELECT n_nationkey, n_regionkey, '[' || n_name || ']: ' || string_agg('[' || c_name || ']: ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, n_name)
SELECT 'r' || r_regionkey AS doc_id, '[' || r_name || ']: ' || string_agg(s, chr(10) ORDER BY n_nationkey) AS summary FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def rollup_summaries(spark, d):
    r, n, c = (_t(spark, d, x) for x in ("region", "nation", "customer"))
    none = F.lit("")
    key = lambda x: F.col(x).cast("int")
    a = r.select(_id("r", "r_regionkey").alias("doc_id"), F.array(key("r_regionkey")).alias("path"), F.array().cast("array<int>").alias("parent_path"), F.lit(0).alias("depth"), F.col("r_name").alias("title"), none.alias("content"))
    b = n.select(_id("r", "n_regionkey").alias("doc_id"), F.array(key("n_regionkey"), key("n_nationkey")).alias("path"), F.array(key("n_regionkey")).alias("parent_path"), F.lit(1).alias("depth"), F.col("n_name").alias("title"), none.alias("content"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    e = j.select(_id("r", "n_regionkey").alias("doc_id"), F.array(key("n_regionkey"), key("n_nationkey"), key("c_custkey")).alias("path"), F.array(key("n_regionkey"), key("n_nationkey")).alias("parent_path"), F.lit(2).alias("depth"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content"))
    return traverse.roll_up(a.unionByName(b).unionByName(e)).where("size(path) = 1").select("doc_id", "summary")


TREE = "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey"


def _tree_docs(spark, d) -> DataFrame:
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    child = F.struct(F.lit("entries").alias("type"), _id("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Land of {@creature "), F.col("n_name"), F.lit("|R"), F.col("n_regionkey"), F.lit("}"))).alias("entries"))
    kids = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", child.alias("c")))), lambda x: x["c"]).alias("kids"))
    j = r.join(kids, r.r_regionkey == kids.n_regionkey)
    root = F.struct(F.lit("section").alias("type"), _id("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("kids").alias("entries"))
    return j.select(_id("r", "r_regionkey").alias("doc_id"), F.to_json(F.struct(F.array(root).alias("data"))).alias("body"))


@query(f"""
SELECT 'r' || r_regionkey AS doc_id, 0 AS depth, 'r' || r_regionkey AS node_id, r_name AS title, '' AS content, 0 AS n_links FROM region
UNION ALL SELECT 'r' || r_regionkey, 1, 'n' || n_nationkey, n_name, 'Land of ' || n_name, 1 FROM ({TREE})""")
def tree_flatten(spark, d):
    return flatten.flatten(_tree_docs(spark, d)).select("doc_id", "depth", "node_id", "title", "content", F.size("links").alias("n_links"))


@query(f"SELECT 'r' || r_regionkey AS doc_id, 'n' || n_nationkey AS source_id, 'creature' AS entity_type, n_name || '|R' || r_regionkey AS identifier FROM ({TREE})")
def tree_external_refs(spark, d):
    refs = flatten.external_refs(flatten.flatten(_tree_docs(spark, d), "indexed"))
    return refs.select("doc_id", "source_id", "entity_type", "identifier")


@query(f"SELECT 'r' || r_regionkey AS doc_id, 'n' || n_nationkey AS node_id, r_name || ' > ' || n_name AS breadcrumb FROM ({TREE}) UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, r_name FROM region")
def tree_breadcrumbs(spark, d):
    nodes = flatten.flatten(_tree_docs(spark, d))
    return traverse.breadcrumbs(nodes).join(nodes, ["doc_id", "path"]).select("doc_id", "node_id", "breadcrumb")


@query("""
SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]')) AS n_headings, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages""")
def html_outline(spark, d):
    p = _t(spark, d, "pages")
    n = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return p.select("page_id", n("(?i)<h[1-6]").alias("n_headings"), n("(?i)<p[ >]").alias("n_paragraphs"), F.coalesce(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")).alias("title"))


@query("SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'supplied_by' AS relation, l_returnflag AS \"desc\" FROM lineitem")
def parse_relations_block(spark, d):
    li = _t(spark, d, "lineitem")
    text = F.concat(F.lit("<relations>\nSource: p"), F.col("l_partkey"), F.lit("\nRelation: supplied_by\nTarget: s"), F.col("l_suppkey"), F.lit("\nDescription: "), F.col("l_returnflag"), F.lit("\n\nSource: \nTarget: x\nRelation: none\n</relations>"))
    return li.select("l_orderkey", "l_linenumber", F.explode(parsers.relations(text)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT s_suppkey, 's' || s_suppkey AS old_id, 'n' || s_nationkey AS new_id FROM supplier")
def parse_resolution_map(spark, d):
    s = _t(spark, d, "supplier")
    text = F.concat(F.lit("# ids\n\nsame -> same\ns"), F.col("s_suppkey"), F.lit(" -> first\ns"), F.col("s_suppkey"), F.lit(": n"), F.col("s_nationkey"))
    return s.select("s_suppkey", F.explode(parsers.resolution_map(text)).alias("old_id", "new_id"))


@query("SELECT conv_id, turn, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, length(text) AS n_query FROM conversations WHERE role <> 'system' QUALIFY role = 'user'")
def chat_history(spark, d):
    from pyspark.sql.window import Window

    c = _t(spark, d, "conversations").where("role <> 'system'")
    c = c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), "answer", F.length("text").cast("long").alias("n_query"))


from . import queries_documents, queries_graphs, queries_stores  # noqa: E402, F401  they register themselves
