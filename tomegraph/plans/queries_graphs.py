"""Queries on catalogs, views, merging and evaluation, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical, chains, evaluate, graph, hetero, metrics, paths, ranks, resolve, search, stats, views
from ..sources import catalogs, graphs, sinks
from .queries import NATION_NODES, PLACES, SUPPLY, _brand_nodes, _events, _id, _nation_nodes, _place_edges, _supply_edges, _t, query
from .queries_documents import _cat

S = F.lit

# --- catalogs -----------------------------------------------------------------------------------


def _catalog_docs(spark, d) -> DataFrame:
    """A file a brand: records under two keys, a source that is a number, records without a name, and a file that isn't JSON."""
    record = _cat('{"name": "', F.col("p_name"), '", "source": ', F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string")).otherwise(_cat('"', F.col("p_type"), '"')), ', "key": ', F.col("p_partkey"), "}")
    p = _t(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey"), (F.col("p_size") % 2 == 0).alias("even"), record.alias("r"))
    of = lambda even: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("even") == S(even), F.struct("p_partkey", "r")))), lambda x: x["r"]), ", ")
    docs = p.groupBy("doc_id").agg(_cat('{"other": [{"name": "no"}], "baseitem": [', of(True), ', {"source": "nameless"}], "item": [', of(False), "]}").alias("body"))
    return docs.unionByName(spark.createDataFrame([("Brand#0", "{broken"), ("Brand#00", None)], "doc_id string, body string"))


_SOURCE = "CASE WHEN p_size % 5 = 0 THEN p_size::VARCHAR ELSE p_type END"


@query(f"SELECT p_partkey, p_name AS name, {_SOURCE} AS source, row_number() OVER (ORDER BY p_brand, p_size % 2 = 0, p_partkey) AS place FROM part")
def catalog_records(spark, d):
    c = catalogs.read_catalog(_catalog_docs(spark, d), "item")
    key = F.get_json_object("body", "$.key").cast("long")
    return ranks.numbered(c.orderBy("ord").select(key.alias("p_partkey"), "name", "source"), "place")


@query(f"""
WITH c AS (SELECT p_partkey, p_name AS name, {_SOURCE} AS source, row_number() OVER (ORDER BY p_brand, p_size % 2 = 0, p_partkey) AS ord FROM part)
SELECT lower(name) AS name, lower(source) AS source, arg_max(p_partkey, ord) AS p_partkey FROM c GROUP BY 1, 2""")
def catalog_index(spark, d):
    c = catalogs.index(catalogs.read_catalog(_catalog_docs(spark, d), "item"))
    return c.select(F.lower("name").alias("name"), F.lower("source").alias("source"), F.get_json_object("body", "$.key").cast("long").alias("p_partkey"))


def _catalog(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"))


_FIRST = "WITH c AS (SELECT lower(p_name) AS t, min(p_partkey) AS ord FROM part GROUP BY 1), r AS (SELECT s_suppkey AS ref_id, p_name, p_brand, s_suppkey % 4 AS how FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _refs(spark, d, names: list[Column]) -> DataFrame:
    """A reference a supplier, its name after one of four rules."""
    j = _t(spark, d, "supplier").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    how = F.col("s_suppkey") % 4
    name = names[3]
    for i in range(3):
        name = F.when(how == i, names[i]).otherwise(name)
    return j.select(F.col("s_suppkey").alias("ref_id"), name.alias("name"), S("nowhere").alias("source"))


@query(f"""
{_FIRST}, n AS (SELECT ref_id, CASE how WHEN 0 THEN lower(p_name) WHEN 1 THEN substr(lower(p_name), 2) WHEN 2 THEN 'the ' || lower(p_name) || 's' ELSE 'qqq' END AS q, how FROM r)
SELECT ref_id, coalesce(min(CASE WHEN q = t THEN ord END), min(ord), -1) AS matched_ord, CASE WHEN count(t) = 0 THEN 0 WHEN bool_or(q = t) THEN CASE WHEN how = 0 THEN 3 ELSE 2 END ELSE 4 END AS tier
FROM n LEFT JOIN c ON contains(t, q) OR contains(q, t) GROUP BY ref_id, how""")
def catalog_creature_lookup(spark, d):
    """Without case, a part of the name, more than the name, nothing."""
    refs = _refs(spark, d, [F.upper(F.col("p_name")), F.expr("substring(p_name, 2)"), _cat("the ", F.col("p_name"), "s"), S("qqq")])
    return resolve.match(refs, _catalog(spark, d), "creature").select("ref_id", F.coalesce("matched_ord", S(-1)).alias("matched_ord"), F.coalesce("tier", S(0)).alias("tier"))


@query(f"""
{_FIRST}, n AS (SELECT ref_id, CASE how WHEN 0 THEN lower(p_name) WHEN 1 THEN substr(lower(p_name), 2) WHEN 2 THEN 'the ' || lower(p_name) || 's' ELSE 'qqq' END AS q, how FROM r)
SELECT ref_id, coalesce(min(CASE WHEN q = t THEN ord END), min(ord), -1) AS matched_ord, CASE WHEN count(t) = 0 THEN 0 WHEN bool_or(q = t) THEN CASE WHEN how = 0 THEN 3 ELSE 2 END ELSE 4 END AS tier
FROM n LEFT JOIN c ON contains(t, q) GROUP BY ref_id, how""")
def catalog_item_lookup(spark, d):
    refs = _refs(spark, d, [F.upper(F.col("p_name")), F.expr("substring(p_name, 2)"), _cat("the ", F.col("p_name"), "s"), S("qqq")])
    return resolve.match(refs, _catalog(spark, d), "item").select("ref_id", F.coalesce("matched_ord", S(-1)).alias("matched_ord"), F.coalesce("tier", S(0)).alias("tier"))


@query(f"""
{_FIRST} SELECT ref_id, CASE WHEN how = 0 THEN ord ELSE coalesce((SELECT min(ord) FROM c x WHERE how = 1 AND x.t = substr(lower(p_name), 2)), -1) END AS matched_ord FROM r JOIN c ON t = lower(p_name)""")
def catalog_spell_lookup(spark, d):
    refs = _refs(spark, d, [F.upper(F.col("p_name")), F.expr("substring(p_name, 2)"), _cat("the ", F.col("p_name"), "s"), S("qqq")])
    return resolve.match(refs, _catalog(spark, d), "spell").select("ref_id", F.coalesce("matched_ord", S(-1)).alias("matched_ord"))


@query("""
WITH f AS (SELECT lower(p_name) AS n, arg_min(p_brand, p_partkey) AS s FROM part GROUP BY 1), l AS (SELECT lower(p_name) AS n, lower(p_brand) AS s, max(p_partkey) AS ord FROM part GROUP BY 1, 2),
r AS (SELECT s_suppkey AS ref_id, p_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN p_brand END AS source FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT ref_id, coalesce(source, f.s) AS source, l.ord AS hit FROM r JOIN f ON f.n = lower(name) JOIN l ON l.n = lower(name) AND l.s = lower(coalesce(source, f.s))""")
def default_sources(spark, d):
    """Tags without a source take the first one seen, and the last record of that name and source."""
    j = _t(spark, d, "supplier").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    refs = j.select(F.col("s_suppkey").alias("ref_id"), F.upper(F.col("p_name")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("p_brand")).alias("source"))
    return resolve.with_default_source(refs, _catalog(spark, d)).select("ref_id", "source", F.col("record.ord").alias("hit"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE lag(p_type, (p_partkey % 3)::INT) OVER (ORDER BY p_partkey) END AS kind, p_size AS size, CASE p_partkey % 3 WHEN 0 THEN 'A,B,C' WHEN 1 THEN 'B2,C,D' ELSE 'B2,C,D,E' END AS action,
 CASE p_partkey % 3 WHEN 0 THEN 'the wolf runs' ELSE 'Rex runs' END AS text FROM part""")
def record_inheritance(spark, d):
    """Every third record stands alone; the next copies it with patches, and the one after copies that."""
    prior = _cat("n", F.col("p_partkey") - 1)
    alone = _cat('{"kind": "', F.col("p_type"), '", "size": ', F.col("p_size"), ', "hasToken": true, "action": [{"name": "A"}, {"name": "B"}, {"name": "C"}], "text": "the wolf runs"}')
    patched = _cat('{"size": ', F.col("p_size"), ', "_copy": {"name": "', prior, '", "source": "X", "_mod": {"*": {"mode": "replaceTxt", "replace": "THE WOLF", "with": "Rex", "flags": "i"}, "action": [{"mode": "removeArr", "names": "A"}, {"mode": "replaceArr", "replace": "B", "items": {"name": "B2"}}, {"mode": "appendArr", "items": {"name": "D"}}]}}}')
    last = _cat('{"size": ', F.col("p_size"), ', "_copy": {"name": "', F.upper(prior), '", "_mod": {"action": {"mode": "appendArr", "items": [{"name": "E"}]}, "none": {"mode": "appendArr", "items": 1}}}}')
    body = F.when(F.col("p_partkey") % 3 == 0, alone).when(F.col("p_partkey") % 3 == 1, patched).otherwise(last)
    catalog = _t(spark, d, "part").select(F.col("p_partkey").alias("ord"), _cat("n", F.col("p_partkey")).alias("name"), S("X").alias("source"), body.alias("body"))
    b = F.from_json("body", "kind string, size int, text string, action array<struct<name: string>>, hasToken boolean, _copy string")
    got = resolve.inherited(catalog, "creature").select(F.col("ord").alias("p_partkey"), b.alias("b")).where("b.hasToken IS NULL AND b._copy IS NULL")
    return got.select("p_partkey", "b.kind", "b.size", F.array_join(F.transform("b.action", lambda a: a["name"]), ",").alias("action"), "b.text")


@query("""
SELECT p_partkey, p_size % 2 = 0 AS listed, CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'Unknown' END AS size, p_type AS creature_type, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS armor_class, p_size * 2 AS hit_points, p_size AS strength, 10 AS wisdom, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS senses, 'Bite,Howl' AS actions, CASE WHEN p_size % 2 = 0 THEN '1/2' ELSE 'Unknown' END AS rating FROM part""")
def creature_properties(spark, d):
    even = F.col("p_size") % 2 == 0
    body = F.when(even, _cat('{"size": ["L", "M"], "type": {"type": "', F.col("p_type"), '"}, "ac": [{"ac": ', F.col("p_size"), '}], "hp": {"average": ', F.col("p_size") * 2, '}, "str": ', F.col("p_size"), ', "senses": ["', F.col("p_name"), '"], "cr": {"cr": "1/2"}, "action": [{"name": "Bite"}, {"name": "Howl"}]}'))
    body = F.when(even, body).otherwise(_cat('{"type": "', F.col("p_type"), '", "hp": {"average": ', F.col("p_size") * 2, '}, "str": ', F.col("p_size"), ', "action": [{"name": "Bite"}, {"name": "Howl"}]}'))
    p = _t(spark, d, "part").select(F.col("p_partkey"), even.alias("listed"), resolve.creature_properties(F.parse_json(body)).alias("x"))
    return p.select("p_partkey", "listed", "x.size", "x.creature_type", "x.armor_class", "x.hit_points", "x.abilities.strength", "x.abilities.wisdom", F.array_join("x.senses", ",").alias("senses"), F.array_join("x.actions", ",").alias("actions"), F.col("x.challenge_rating").alias("rating"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'rare' ELSE 'Unknown' END AS rarity, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Unknown' END AS type, p_size % 2 = 0 AS attunement, p_size % 3 = 0 AS wondrous, p_size::DOUBLE AS weight, CASE WHEN p_size % 2 = 0 THEN '1d6' ELSE '' END AS damage, CASE WHEN p_size % 6 = 0 THEN 'S' ELSE '' END AS damage_type FROM part""")
def item_properties(spark, d):
    a = F.when(F.col("p_size") % 2 == 0, ', "rarity": "rare", "reqAttune": "by a wizard", "dmg1": "1d6"').otherwise("")
    b = F.when(F.col("p_size") % 3 == 0, _cat(', "type": "', F.col("p_type"), '", "wondrous": true, "dmgType": "S"')).otherwise("")
    p = _t(spark, d, "part").select(F.col("p_partkey"), resolve.item_properties(F.parse_json(_cat('{"weight": ', F.col("p_size"), a, b, "}"))).alias("x"))
    return p.select("p_partkey", "x.rarity", "x.type", F.col("x.requires_attunement").alias("attunement"), "x.wondrous", "x.weight", F.coalesce("x.damage", S("")).alias("damage"), F.coalesce("x.damage_type", S("")).alias("damage_type"))


@query("""
SELECT p_partkey, p_size % 10 AS level, CASE WHEN p_size % 2 = 0 THEN p_size || ' bonus' ELSE 'Unknown' END AS casting_time, CASE WHEN p_size % 3 = 0 THEN 'point ' || p_size || ' feet' ELSE 'Unknown' END AS range,
 CASE WHEN p_size % 4 = 0 THEN p_size || ' minute' WHEN p_size % 4 = 1 THEN 'permanent' ELSE 'Instant' END AS duration, p_size % 4 = 0 AS concentration, p_type AS damage FROM part""")
def spell_properties(spark, d):
    time = F.when(F.col("p_size") % 2 == 0, _cat(', "time": [{"number": ', F.col("p_size"), ', "unit": "bonus"}]')).otherwise("")
    far = F.when(F.col("p_size") % 3 == 0, _cat(', "range": {"type": "point", "distance": {"type": "feet", "amount": ', F.col("p_size"), "}}")).otherwise("")
    lasts = F.when(F.col("p_size") % 4 == 0, _cat(', "duration": [{"type": "timed", "duration": {"type": "minute", "amount": ', F.col("p_size"), '}, "concentration": true}]')).when(F.col("p_size") % 4 == 1, ', "duration": [{"type": "permanent"}]').otherwise("")
    p = _t(spark, d, "part").select(F.col("p_partkey"), resolve.spell_properties(F.parse_json(_cat('{"level": ', F.col("p_size") % 10, time, far, lasts, ', "damageInflict": ["', F.col("p_type"), '"]}'))).alias("x"))
    return p.select("p_partkey", "x.level", "x.casting_time", "x.range", "x.duration", F.col("x.requires_concentration").alias("concentration"), F.array_join("x.damage_types", ",").alias("damage"))


def _external(spark, d) -> DataFrame:
    """References of suppliers' sections: items that the catalog holds or not, and backgrounds."""
    j = _t(spark, d, "supplier").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    known = F.col("s_suppkey") % 3
    name = F.when(known == 1, _cat("zz", F.col("p_name"))).otherwise(F.col("p_name"))
    kind = F.when(known == 2, "background").otherwise("item")
    return j.select(kind.alias("entity_type"), F.when(known == 2, name).otherwise(F.concat_ws("|", name, F.col("p_brand"))).alias("identifier"), name.alias("display_name"), _id("s", "s_suppkey").alias("source_id"))


_EXTERNAL = "SELECT CASE WHEN s_suppkey % 3 = 2 THEN 'background' ELSE 'item' END AS kind, CASE WHEN s_suppkey % 3 = 1 THEN 'zz' ELSE '' END || p_name AS name, p_brand AS brand, 's' || s_suppkey AS source_id, s_suppkey FROM supplier JOIN part ON p_partkey = s_suppkey"


def _resolved(spark, d) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), _cat('{"rarity": "', F.col("p_type"), '"}').alias("body"))
    return resolve.resolve_all(_external(spark, d), {"item": p})


_RESOLVED = f"""
WITH x AS ({_EXTERNAL}), g AS (SELECT kind, name, CASE WHEN kind = 'item' THEN brand END AS brand, string_agg(source_id, ',' ORDER BY source_id) AS mentions FROM x GROUP BY 1, 2, 3),
m AS (SELECT g.*, (SELECT min(p_partkey) FROM part WHERE p_name = g.name AND p_brand = g.brand) AS hit FROM g),
e AS (SELECT replace(name, ' ', '_') AS id, name AS label, CASE WHEN kind = 'background' THEN 'Group' ELSE 'Item' END AS type, CASE WHEN kind = 'background' THEN 'Adventure' ELSE brand END AS source_file, mentions, kind, coalesce(hit, -1) AS hit, coalesce((SELECT p_type FROM part WHERE p_partkey = hit), 'Unknown') AS rarity FROM m)"""


@query(f"{_RESOLVED} SELECT id, label, type, source_file, mentions, kind, hit, CASE WHEN kind = 'item' THEN rarity ELSE '' END AS rarity FROM e")
def resolved_entities(spark, d):
    """Found in the catalog, stood in for by a default, or kept as a reference."""
    r = _resolved(spark, d)
    return r.select("id", "label", "type", "source_file", F.array_join("mentions", ",").alias("mentions"), F.col("entity_type").alias("kind"), F.coalesce("matched_ord", S(-1)).alias("hit"), F.coalesce(F.get_json_object("properties", "$.rarity"), S("")).alias("rarity"))


@query(f"{_RESOLVED} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, count(*) FILTER (WHERE hit >= 0) AS n_matched, count(*) FILTER (WHERE hit < 0) AS n_unmatched FROM e GROUP BY ROLLUP (kind)")
def resolution_totals(spark, d):
    out = stats.resolution_stats(_resolved(spark, d))
    return out.select(F.coalesce("entity_type", S("all")).alias("kind"), "n", "n_matched", "n_unmatched")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || '2' WHEN 2 THEN 'text' ELSE '' END AS creature_type, CASE WHEN p_size % 4 = 3 THEN CASE WHEN p_size % 8 = 3 THEN 'cave' ELSE 'building' END ELSE '' END AS location_type, p_size % 4 <> 3 AND (p_name LIKE '%s' AND length(p_name) > 4) AS is_generic FROM part""")
def seed_nodes(spark, d):
    p = F.when(F.col("p_size") % 4 == 0, _cat('{"creature_type": {"type": "', F.col("p_type"), '"}}')).when(F.col("p_size") % 4 == 1, _cat('{"creature_type": ["', F.col("p_type"), '2", "x"]}')).when(F.col("p_size") % 4 == 2, '{"creature_type": "text"}').when(F.col("p_size") % 8 == 3, '{"location_type": "cave"}').otherwise("{}")
    e = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 4 == 3, "Location").otherwise("Creature").alias("type"), p.alias("properties"))
    return resolve.seeds(e).select(F.col("id").cast("long").alias("p_partkey"), F.coalesce("creature_type", S("")).alias("creature_type"), F.coalesce("location_type", S("")).alias("location_type"), "is_generic")


@query("SELECT md5(lower('item:' || p_name || ':' || p_brand)) AS id, 'Item' AS label, p_name AS name, p_brand AS source, p_type AS kind FROM part JOIN (SELECT max(p_partkey) AS k FROM part GROUP BY p_name, p_brand) ON k = p_partkey")
def catalog_vertices(spark, d):
    catalog = _t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), _cat('{"kind": "', F.col("p_type"), '"}').alias("body"))
    refs = catalog.select("name", "source").distinct()
    v = resolve.vertices(refs, catalog, "item")
    return v.select("id", "label", "name", "source", F.get_json_object("attributes", "$.kind").alias("kind"))


# --- canonical ids ------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 5 THEN 'new' || s_suppkey ELSE 'n' || s_nationkey END AS new_id, CASE s_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS tier FROM supplier""")
def canonical_ids(spark, d):
    """By id, label, own alias, alias of the known one, a similar label, and none."""
    s = _t(spark, d, "supplier")
    how, nation = F.col("s_suppkey") % 6, F.col("s_nationkey")
    word = lambda a, b: F.concat(S(a), F.substring(F.md5(F.concat(S(b), nation.cast("string")).cast("binary")), 1, 24))
    known = _t(spark, d, "nation").select(_id("n", "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    key = F.expr("substring(id, 2)")
    name = lambda a, b: F.concat(S(a), F.substring(F.md5(F.concat(S(b), key).cast("binary")), 1, 24))
    unique = known.select("id", name("", "label").alias("label"), F.array(name("", "alias")).alias("aliases"), "ord")
    label = F.when(how == 0, "?").when(how == 1, F.upper(word("", "label"))).when(how == 2, S("")).when(how == 3, word("", "alias")).when(how == 4, F.concat(word("", "label"), S("z"))).otherwise(F.concat(S("qq"), F.col("s_suppkey").cast("string")))
    own = F.when(how == 0, F.concat(S("n"), nation.cast("string"))).otherwise(F.concat(S("new"), F.col("s_suppkey").cast("string")))
    raw = s.select(F.when(how == 0, own).otherwise(own).alias("id"), label.alias("label"), F.when(how == 2, F.array(word("", "label"))).otherwise(F.array().cast("array<string>")).alias("aliases"), "s_suppkey")
    out = canonical.canonical_ids(raw.select("id", "label", "aliases"), unique)
    return raw.select("s_suppkey", "id").join(out, F.col("id") == F.col("old_id")).select("s_suppkey", "new_id", F.coalesce("tier", S(0)).alias("tier"))


# --- merging ------------------------------------------------------------------------------------


_LONGEST = "SELECT id, arg_max(label, length(label) * 1000000000 - ord) AS label, arg_max(type, length(label) * 1000000000 - ord) AS type, min(ord) AS ord FROM ({}) GROUP BY id"


@query(f"SELECT 'node' AS kind, id AS a, label AS b, type AS c FROM ({_LONGEST.format('SELECT p_brand AS id, p_name AS label, p_type AS type, p_partkey AS ord FROM part')}) UNION ALL SELECT DISTINCT 'edge', source, target, relation FROM ({SUPPLY})")
def deduplicated_graph(spark, d):
    n, e = graph.deduplicate(_brand_nodes(spark, d), _supply_edges(spark, d))
    return n.select(S("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("type").alias("c")).unionByName(e.select(S("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c")))


@query(f"""
WITH n AS (SELECT id, label, type, ord + CASE WHEN type = 'nation' THEN 0 ELSE 1000000 END AS ord FROM ({NATION_NODES})), e AS (SELECT source, target, relation FROM ({PLACES}) UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'buys' FROM customer WHERE c_acctbal > 0)
SELECT 'node' AS kind, id AS a, label AS b, type AS c FROM ({_LONGEST.format('SELECT * FROM n')}) UNION ALL SELECT DISTINCT 'edge', source, target, relation FROM e""")
def merged_graphs(spark, d):
    """Two graphs in order: the longest label of an id, the first edge of a key."""
    n = _nation_nodes(spark, d)
    c = _t(spark, d, "customer").where("c_acctbal > 0")
    buys = c.select(_id("n", "c_nationkey").alias("source"), _id("c", "c_custkey").alias("target"), S("buys").alias("relation"), F.col("c_custkey").alias("ord"))
    places = _place_edges(spark, d).withColumn("ord", F.xxhash64("source", "target") % 1000)
    nodes, edges = graph.merge([(n.where("type = 'nation'"), places), (n.where("type <> 'nation'"), buys.unionByName(places))])
    return nodes.select(S("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("type").alias("c")).unionByName(edges.select(S("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c")))


@query("""
WITH k AS (SELECT 'p' || p_partkey AS id FROM part ORDER BY p_partkey LIMIT 100), s AS (SELECT l_partkey AS a, l_partkey + 1 AS b FROM lineitem)
SELECT DISTINCT 'p' || a AS source, 'p' || b AS target FROM s WHERE 'p' || a IN (SELECT id FROM k) AND 'p' || b IN (SELECT id FROM k)""")
def sampled_graph(spark, d):
    """The first hundred nodes and the edges among them: the operator is a sample."""
    n = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    e = _t(spark, d, "lineitem").select(_id("p", "l_partkey").alias("source"), F.concat(S("p"), F.col("l_partkey") + 1).alias("target")).distinct()
    return graph.sample(n, e, 100)[1]


@query(f"SELECT 'node' AS kind, id FROM (SELECT 'c' || c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 1000) UNION ALL SELECT 'edge', target FROM ({PLACES} ORDER BY target LIMIT 200)")
def display_caps(spark, d):
    """What a display shows at most: the operator is a cap."""
    n = _t(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    e = _place_edges(spark, d).withColumn("ord", F.col("target"))
    return views.capped(n, 1000).select(S("node").alias("kind"), "id").unionByName(views.capped(e, 200).select(S("edge").alias("kind"), F.col("target").alias("id")))


@query(f"SELECT target FROM ({PLACES}) WHERE source = 'n7' OR target = 'n7'")
def incident_edges(spark, d):
    return graph.incident(_place_edges(spark, d), "n7").select("target")


@query(f"SELECT source, target, relation FROM ({SUPPLY}) WHERE regexp_matches(relation, '^[AN]$')")
def relations_by_pattern(spark, d):
    return hetero.relations_like(_supply_edges(spark, d), "^[AN]$").select("source", "target", "relation")


@query("SELECT DISTINCT p_name AS label FROM part")
def search_suggestions(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("label"))
    return hetero.suggestions(p.unionByName(spark.createDataFrame([(" ",), (None,)], "label string")))


@query(f"""
WITH e AS (SELECT 'e' || event_id AS id, 'u' || user_id AS who, 'k' || json_extract_string(props, '$.k') AS loc, event_id FROM events WHERE event_id % 3 <> 0),
n AS (SELECT 'u' || user_id AS id, max('User ' || user_id) AS label FROM events GROUP BY user_id), m AS (SELECT id, CASE WHEN id IN ('u1', 'u2') THEN 'u3' ELSE id END AS new FROM n)
SELECT 'node' AS kind, id AS a, 'entity' AS b, '' AS c FROM n UNION ALL SELECT 'node', id, 'event', '' FROM e
UNION ALL SELECT DISTINCT 'edge', e.id, m.new, 'has_participant' FROM e JOIN m ON m.id = e.who UNION ALL SELECT DISTINCT 'edge', a.new, b.new, 'knows' FROM n x JOIN m a ON a.id = x.id JOIN m b ON b.id = 'u' || (substr(x.id, 2)::INT + 1) WHERE a.new <> b.new""")
def assembled_graph(spark, d):
    """Entities filtered and merged, events with their edges, relations remapped, dangling ones dropped."""
    users = _t(spark, d, "events").select("user_id").distinct()
    entities = users.select(_id("u", "user_id").alias("id"), F.concat(S("User "), F.col("user_id")).alias("label"), S("Creature").alias("type"), F.col("user_id").alias("ord"))
    entities = entities.unionByName(spark.createDataFrame([("location_3", "x", "Location", 1), ("thing_1", "y", "Item", 2)], entities.schema))
    lone = F.col("ord") % 3 == 0
    events = _events(spark, d).withColumn("participants", F.when(lone, F.array(S(" "))).otherwise(F.col("participants"))).withColumn("location", F.when(lone, S("")).otherwise(F.col("location")))
    relations = users.select(_id("u", "user_id").alias("source"), F.concat(S("u"), F.col("user_id") + 1).alias("target"), S("knows").alias("relation"), S("").alias("desc"))
    mapping = spark.createDataFrame([("u1", "u3"), ("u2", "u3")], "old_id string, new_id string")
    nodes, edges = hetero.assemble(entities, events.select("id", "label", "type", "participants", "location", "description", "ord"), relations, mapping)
    return nodes.select(S("node").alias("kind"), F.col("id").alias("a"), F.col("node_type").alias("b"), S("").alias("c")).unionByName(edges.select(S("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c")))


@query("""
WITH n AS (SELECT 'c' || c_custkey AS id, c_name AS label FROM customer), e AS (SELECT DISTINCT 'c' || o_custkey AS source, 'has' AS relation, 's' || o_orderstatus AS target FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM n))
SELECT 'node' AS kind, id AS a, CASE WHEN substr(id, 2)::INT % 2 = 0 THEN 'New ' || label ELSE label END AS b FROM n UNION ALL SELECT 'node', 's' || s, s FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) UNION ALL SELECT 'edge', source, target FROM e WHERE substr(source, 2)::INT % 2 = 0""")
def keyed_graph_upsert(spark, d):
    """Nodes replaced by id, then edges whose ends both exist."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    base = c.select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"))
    new = base.where("ord % 2 = 0").withColumn("label", F.concat(S("New "), F.col("label"))).unionByName(o.select(_id("s", "o_orderstatus").alias("id"), F.col("o_orderstatus").alias("label"), S(0).cast("long").alias("ord")).distinct())
    edges = o.where("o_custkey % 2 = 0").select(_id("c", "o_custkey").alias("source"), _id("s", "o_orderstatus").alias("target"), S("has").alias("relation"), F.col("o_orderkey").alias("ord"))
    dangling = o.select(F.concat(S("x"), F.col("o_custkey")).alias("source"), S("sF").alias("target"), S("has").alias("relation"), F.col("o_orderkey").alias("ord"))
    nodes, kept, _ = sinks.upsert_graph((base, edges.limit(0)), (new, edges.unionByName(dangling)))
    return nodes.select(S("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(kept.select(S("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


# --- views --------------------------------------------------------------------------------------


def _typed(spark, d) -> DataFrame:
    """Customers by segment, nations and events' types as nodes of several kinds."""
    c, n, e = (_t(spark, d, x) for x in ("customer", "nation", "events"))
    a = c.select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "Creature").otherwise("group").alias("type"), S("entity").alias("node_type"))
    b = n.select(_id("n", "n_nationkey").alias("id"), S(" ").alias("label"), S("LOCATION").alias("type"), S("entity").alias("node_type"))
    return a.unionByName(b).unionByName(e.select(_id("e", "event_type").alias("id"), F.col("event_type").alias("label"), F.col("event_type").alias("type"), S("event").alias("node_type")).distinct())


TYPED = "SELECT 'c' || c_custkey AS id, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN 'Creature' ELSE 'group' END AS type FROM customer UNION ALL SELECT 'n' || n_nationkey, ' ', 'LOCATION' FROM nation UNION ALL SELECT DISTINCT 'e' || event_type, event_type, event_type FROM events"


@query(f"SELECT 'node' AS kind, id AS a FROM ({TYPED}) WHERE type = 'Creature' OR id LIKE 'e%' UNION ALL SELECT 'both', target FROM ({PLACES}) WHERE source LIKE 'n%' AND substr(target, 2)::INT % 2 = 0")
def named_filters(spark, d):
    n, e = _typed(spark, d), _place_edges(spark, d)
    some = views.by_filters(n, e, ["creature", "event"])[0].select(S("node").alias("kind"), F.col("id").alias("a"))
    return some.unionByName(views.by_filters(n, e, ["creature", "location"])[1].select(S("both").alias("kind"), F.col("target").alias("a")))


@query(f"""
WITH g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({PLACES}) UNION ALL SELECT target FROM ({PLACES})) GROUP BY id), n AS (SELECT t.id, label, type, coalesce(degree, 0) AS degree FROM ({TYPED}) t LEFT JOIN g ON g.id = t.id),
s AS (SELECT *, 25 + least(degree * 3, 60) AS size, CASE WHEN trim(label) = '' THEN id ELSE label END AS shown, upper(substr(type, 1, 1)) || lower(substr(type, 2)) AS kind FROM n)
SELECT id, degree, size, CASE WHEN kind = 'Location' THEN '#f1b8f1' ELSE '#34CAF7' END AS colour, CASE WHEN length(shown) > greatest(4, floor(size / 3.5)) THEN substr(shown, 1, greatest(4, floor(size / 3.5))::INT) || '..' ELSE shown END AS display_label, shown || chr(10) || '[' || kind || ']' AS tooltip FROM s""")
def drawn_nodes(spark, d):
    return views.drawn(_typed(spark, d), _place_edges(spark, d)).select("id", "degree", "size", "colour", "display_label", "tooltip")


@query(f"SELECT DISTINCT upper(substr(type, 1, 1)) || lower(substr(type, 2)) AS type FROM ({TYPED})")
def filter_types(spark, d):
    return views.filter_types(_typed(spark, d))


_PREFIXED = "SELECT id FROM (SELECT 'n' || n_nationkey AS id FROM nation UNION SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0)"


@query(f"SELECT 'node' AS kind, id AS a FROM ({_PREFIXED}) UNION ALL SELECT 'edge', target FROM ({PLACES}) WHERE source LIKE 'n%' AND substr(target, 2)::INT % 3 = 0 UNION ALL SELECT DISTINCT 'small', x FROM (SELECT unnest([source, target]) AS x FROM ({PLACES}) WHERE source LIKE 'n%' AND substr(target, 2)::INT % 3 = 0)")
def combined_views(spark, d):
    """Places and creatures with prefixed ids become one graph; beyond the most nodes only what the creatures touch."""
    n, c = _t(spark, d, "nation"), _t(spark, d, "customer").where("c_custkey % 3 = 0")
    places = n.select(F.concat(S("location:n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("ord"))
    buyers = c.select(F.concat(S("creature:c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"))
    edges = c.select(F.concat(S("location:n"), F.col("c_nationkey")).alias("source"), F.concat(S("creature:c"), F.col("c_custkey")).alias("target"), S("has").alias("relation"), F.col("c_custkey").alias("ord"))
    again = edges.withColumns({"source": views.unprefixed(F.col("source")), "target": views.unprefixed(F.col("target"))})
    nodes, both = views.combined((places, again), (buyers, edges))
    small, _ = views.combined((places, again), (buyers, edges), max_nodes=10)
    out = nodes.select(S("node").alias("kind"), F.col("id").alias("a")).unionByName(both.select(S("edge").alias("kind"), F.col("target").alias("a")))
    return out.unionByName(small.select(S("small").alias("kind"), F.col("id").alias("a")))


@query("WITH n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'n' || n_nationkey FROM nation) SELECT 'locations' AS view, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'creatures', id FROM (SELECT id FROM n ORDER BY id LIMIT 150)")
def export_presets(spark, d):
    """The presets show one type, or the first nodes of two."""
    n, e = _typed(spark, d).withColumn("ord", F.col("id")), _place_edges(spark, d)
    part = lambda name: views.preset(n, e, name)[0].select(S(name).alias("view"), "id")
    return part("locations").unionByName(part("creatures"))


@query("SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, string_agg(DISTINCT substr(repeat(l_returnflag, 60), 1, 50), chr(10) ORDER BY substr(repeat(l_returnflag, 60), 1, 50)) AS tooltip FROM lineitem GROUP BY 1, 2")
def parallel_edge_tooltips(spark, d):
    e = _supply_edges(spark, d).withColumn("relation", F.repeat("relation", S(60)))
    return stats.parallel_edges(e).select("source", "target", "tooltip")


@query(f"SELECT id, NOT (upper(substr(type, 1, 1)) || lower(substr(type, 2))) IN ('Creature', 'Location') AS dim FROM ({TYPED})")
def dimmed_nodes(spark, d):
    return views.highlighted(_typed(spark, d), _place_edges(spark, d), ["Creature", "Location"])[0].select("id", "dim")


# --- evaluation and metrics ---------------------------------------------------------------------


@query("SELECT 'p' || p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'unknown' END AS type FROM part WHERE p_size % 5 <> 0")
def evaluation_entities(spark, d):
    n = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.when(F.col("p_size") % 10 == 0, " ").otherwise(_cat(" ", F.col("p_name"))).alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("type"), F.when(F.col("p_size") % 10 == 5, "event").otherwise("entity").alias("node_type"))
    return graphs.evaluation_entities(n)


@query("SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey % 2 = 1")
def missing_labels(spark, d):
    c = _t(spark, d, "customer")
    found = c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("name"))
    return evaluate.missing(c.select(F.col("c_name").alias("name")), found).select("name")


@query("""
WITH x AS (SELECT c_mktsegment AS type, c_name AS name FROM customer WHERE c_custkey % 3 <> 0)
SELECT type, name, rank, n FROM (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name)::INT AS rank, count(*) OVER (PARTITION BY type) AS n FROM x) WHERE rank <= 30""")
def extra_labels(spark, d):
    """Per type the first thirty names that no label equals: the operator is a short list."""
    c = _t(spark, d, "customer")
    return evaluate.extras(c.where("c_custkey % 3 = 0").select(F.lower("c_name").alias("name")), c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type")))


@query("SELECT DISTINCT lower(p_name) AS label, lower(p_name) AS name, 100.0::DOUBLE AS score, 'exact' AS bucket FROM part")
def best_label_matches(spark, d):
    """Every name against all: each finds itself first."""
    p = _t(spark, d, "part").select(F.col("p_name").alias("name"))
    return evaluate.best_matches(p, p.select(F.upper("name").alias("name")))


@query("""
SELECT DISTINCT lower(p_name) AS label, CASE WHEN length(p_name) % 2 = 0 THEN lower(p_name) ELSE lower(p_name) || '!' END AS extracted, CASE WHEN length(p_name) % 2 = 0 THEN 100.0 ELSE round(200.0 * length(p_name) / (2 * length(p_name) + 1), 6) END::DOUBLE AS score, CASE WHEN length(p_name) % 2 = 0 THEN 'exact' ELSE 'fuzzy' END AS method FROM part""")
def one_to_one_matches(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("name"))
    found = p.select(F.when(F.length("name") % 2 == 0, F.upper("name")).otherwise(F.concat("name", S("!"))).alias("name"))
    return evaluate.greedy_matches(p, found).withColumn("score", F.round("score", 6))


@query("""
SELECT 'c' || o_custkey AS first, 's' || o_orderstatus AS second, 'placed' AS relation, true AS forward, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'c' || c_custkey, 's' || c_mktsegment, 'of', false, 1 FROM customer""")
def type_patterns(spark, d):
    """Edges between two types in either direction."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    status, segment = o.select(_id("s", "o_orderstatus").alias("id")).distinct(), c.select(_id("s", "c_mktsegment").alias("id")).distinct()
    nodes = c.select(_id("c", "c_custkey").alias("id"), S("customer").alias("type")).unionByName(status.unionByName(segment).select("id", S("state").alias("type")))
    edges = o.select(_id("c", "o_custkey").alias("source"), _id("s", "o_orderstatus").alias("target"), S("placed").alias("relation")).unionByName(c.select(_id("s", "c_mktsegment").alias("source"), _id("c", "c_custkey").alias("target"), S("of").alias("relation")))
    return paths.pattern(nodes, edges, "customer", "state").groupBy("first", "second", "relation", "forward").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 NOT IN (0, 1, 2, 3, 4)")
def clean_relations(spark, d):
    k = F.col("o_orderkey") % 7
    source = F.when(k == 0, S(None).cast("string")).when(k == 1, " ").when(k == 2, "<unknown>").when(k == 4, "undefined_target").otherwise("a")
    target = F.when(k == 3, "null").when(k == 5, "undefined_target").otherwise("b")
    return metrics.clean_relations(_t(spark, d, "orders").select("o_orderkey", source.alias("source"), target.alias("target"))).select("o_orderkey")


_REACH = """
WITH RECURSIVE e AS ({edges}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS id FROM both_ways),
reach(start, id, d) AS (SELECT id, id, 0 FROM n UNION SELECT start, b, d + 1 FROM reach JOIN both_ways ON a = id WHERE d < 9),
dist AS (SELECT start, id, min(d) AS d FROM reach GROUP BY ALL)
SELECT '{name}' AS graph, CASE WHEN count(*) = (SELECT count(*) * count(*) FROM n) THEN max(d) END AS diameter FROM dist"""
_GRAPHS = {
    "nations": "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, c_mktsegment FROM customer",
    "few customers": "SELECT 'c' || c_custkey AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 20 = 0 UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 20 = 0",
    "regions": "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation",
}


@query(" UNION ALL ".join(f"SELECT * FROM ({_REACH.format(name=name, edges=edges)})" for name, edges in _GRAPHS.items()))
def graph_diameter(spark, d):
    """Diameters of nations with regions and segments, of customers with segments and nations, and of regions (null: not connected)."""
    n, c = _t(spark, d, "nation"), _t(spark, d, "customer")
    some = c.where("c_custkey % 20 = 0")
    pair = lambda t, a, b: t.select(a.alias("source"), b.alias("target"))
    up = pair(n, _id("r", "n_regionkey"), _id("n", "n_nationkey"))
    segments = pair(c, _id("n", "c_nationkey"), F.col("c_mktsegment"))
    graphs_ = {
        "nations": up.unionByName(segments),
        "few customers": pair(some, _id("c", "c_custkey"), F.col("c_mktsegment")).unionByName(pair(some, _id("c", "c_custkey"), _id("n", "c_nationkey"))),
        "regions": up,
    }
    found = [(name, metrics.diameter(e.select(F.explode(F.array("source", "target")).alias("id")).distinct(), e)) for name, e in graphs_.items()]
    return spark.createDataFrame(found, "graph string, diameter int")


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 0), 6) AS score FROM embeddings e, q WHERE vec_id <> 0)
SELECT '- Doc ' || vec_id || ' --[near]--> l' || label AS line FROM s ORDER BY score DESC, vec_id DESC LIMIT 2""")
def edge_hits(spark, d):
    """The edge half of retrieval: lines of the edges closest to a query vector."""
    e = _t(spark, d, "embeddings")
    query_vector = list(e.where("vec_id = 0").first().embedding)
    edges = e.where("vec_id <> 0").select(_id("v", "vec_id").alias("source"), _id("l", "label").alias("target"), S("near").alias("relation"), S("").alias("desc"), "embedding", F.col("vec_id").alias("ord"))
    nodes = e.select(_id("v", "vec_id").alias("id"), F.concat(S("Doc "), F.col("vec_id")).alias("label"))
    from .context import edge_lines

    return edge_lines(nodes, edges, query_vector, 2).select("line")


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn % 2, turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def history_sizes(spark, d):
    """Turns of a conversation, the odd ones stacked behind the even ones: all of a table come before any of the next."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("long").alias("ord"))
    both = graph.stacked([c.where("turn % 2 = 0"), c.where("turn % 2 = 1")]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "turn"))).alias("t"))
    return both.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"].cast("string")), ",").alias("turns"), F.size("t").cast("long").alias("n"))


@query("""
WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), ' +')) AS w FROM part),
h AS (SELECT p_partkey, ('0x' || md5(w)[1:8])::BIGINT AS h FROM w WHERE w <> ''),
v AS (SELECT p_partkey, h % 128 AS slot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL)
SELECT p_partkey, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)), 5) AS value FROM v WHERE v <> 0""")
def embedding_groups(spark, d):
    """Every entry that isn't zero of the parts' vectors."""
    v = search.embedded(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", search.HashingEmbedder(128))
    return v.select("p_partkey", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("p_partkey", F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value"))


_LINKS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 37 = 0 THEN CASE WHEN p_partkey // 37 % 5 = 4 THEN p_partkey + 36 END ELSE p_partkey - 1 END AS parent FROM part"


@query(f"""
WITH RECURSIVE l AS ({_LINKS}), alive AS (SELECT id, parent FROM l WHERE parent IS NOT NULL),
walk(id, here, d) AS (SELECT id, parent, 1 FROM alive UNION ALL SELECT w.id, a.parent, d + 1 FROM walk w JOIN alive a ON w.here = a.id WHERE d < 80),
far AS (SELECT id, max(d) AS d, arg_max(here, d) AS here FROM walk GROUP BY id),
loops AS (SELECT w.id, min(w.here) AS low FROM walk w JOIN far f ON w.id = f.id WHERE f.d = 80 AND w.d > 40 GROUP BY w.id)
SELECT id, coalesce(low, here) AS root, CASE WHEN low IS NULL THEN d END AS distance, low IS NOT NULL AS cyclic FROM far LEFT JOIN loops USING (id)""")
def copy_chains(spark, d):
    """Parts that copy the one before them: chains of up to 36 links, and cycles of 37."""
    p = F.col("p_partkey")
    ring = F.when((F.floor(p / 37) % 5) == 4, p + 36)
    return chains.ends(_t(spark, d, "part").select(p.alias("id"), F.when(p % 37 == 0, ring).otherwise(p - 1).alias("parent")))
