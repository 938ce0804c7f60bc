"""Queries on content forms, sections, names and replies, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containment, tags
from ..functions import text as T
from ..operators import flatten, parsers, ranks, stats, traverse
from ..session import spread
from .queries import TREE, _id, _t, _tree_docs, query

S = F.lit


def _cat(*parts: Column | str) -> Column:
    """Texts and columns in a row; columns are plain words, which JSON holds as they are."""
    return F.concat(*(S(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _forms(spark, d, entries: Column) -> DataFrame:
    """One document a part, a section with the given entries (JSON text)."""
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("doc_id"), _cat('{"data": [{"type": "section", "id": "s", "name": "', F.col("p_name"), '", "entries": [', entries, "]}]}").alias("body"))


def _contents(spark, d, entries: Column, profile: str = "shadow") -> DataFrame:
    return flatten.flatten(_forms(spark, d, entries), profile).where("depth = 0").select(F.col("doc_id").cast("long").alias("p_partkey"), "content", F.size("links").alias("n_links"), "ignored")


# --- content forms ------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '- ' || p_name || chr(10) ELSE '' END || '- **' || p_brand || '**: ' || p_type || chr(10) || '- The ' || p_name || chr(10) || 'End.' AS content, 1 AS n_links, 0 AS ignored FROM part""")
def content_lists(spark, d):
    first = F.when(F.col("p_size") % 2 == 0, _cat('"', F.col("p_name"), '"')).otherwise("7")
    items = _cat('{"type": "list", "items": [', first, ', {"name": "', F.col("p_brand"), '", "entry": "', F.col("p_type"), '"}, {"entry": "The {@item ', F.col("p_name"), "|", F.col("p_brand"), '}"}, {"name": "lost", "entries": ["x"]}]}, "End."')
    return _contents(spark, d, items)


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '**Table: ' || p_type || ' of ' || p_name || '**' || chr(10) ELSE '' END || p_name || ' | ' || p_size || chr(10) || 'True | None | ' || p_brand || chr(10) || '{"w": ' || p_size || '}' || chr(10) || 'alone' AS content,
 CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_links, 0 AS ignored FROM part""")
def content_tables(spark, d):
    caption = F.when(F.col("p_size") % 3 == 0, _cat('"caption": "', F.col("p_type"), " of {@item ", F.col("p_name"), '}", ')).otherwise("")
    return _contents(spark, d, _cat('{"type": "table", ', caption, '"rows": [["', F.col("p_name"), '", ', F.col("p_size"), '], [true, null, "{@b ', F.col("p_brand"), '}"], [{"w": ', F.col("p_size"), '}], "alone"]}'))


@query("""
SELECT p_partkey, 'Start' || CASE WHEN p_size % 3 = 0 THEN chr(10) || '[Image (map): ' || p_name || ']' WHEN p_size % 3 = 1 THEN chr(10) || '[Image: ' || p_name || ']' ELSE '' END || chr(10) || 'End' AS content, 0 AS n_links, 0 AS ignored FROM part""")
def content_images(spark, d):
    more = F.when(F.col("p_size") % 3 == 0, _cat(', "title": "', F.col("p_name"), '", "imageType": "map"')).when(F.col("p_size") % 3 == 1, _cat(', "title": "', F.col("p_name"), '"')).otherwise(', "title": "", "imageType": "map"')
    return _contents(spark, d, _cat('"Start", {"type": "image"', more, '}, "", "End"'))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '**Gallery:**' || chr(10) || '[Image: ' || p_name || ']' || chr(10) || '[Image (art): ' || p_brand || ']' || chr(10) ELSE '' END || 'End' AS content, 0 AS n_links, 0 AS ignored FROM part""")
def content_galleries(spark, d):
    shown = F.when(F.col("p_size") % 2 == 0, _cat('{"title": "', F.col("p_name"), '"}, {"title": ""}, {"title": "', F.col("p_brand"), '", "imageType": "art"}')).otherwise('{"title": ""}, {}')
    return _contents(spark, d, _cat('{"type": "gallery", "images": [', shown, ']}, "End"'))


@query("""
SELECT p_partkey, '> Said ' || p_name || chr(10) || '> again' AS content, 1 AS n_links, 0 AS ignored FROM part""")
def content_quotes(spark, d):
    return _contents(spark, d, _cat('{"type": "quote", "entries": ["Said {@creature ', F.col("p_name"), '}", {"type": "entries", "entries": ["lost"]}, 5, "again"]}'))


@query("""
SELECT p_partkey, 'a' || chr(10) || 'b' AS content, 0 AS n_links, 1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS ignored FROM part""")
def content_unknown_types(spark, d):
    more = F.when(F.col("p_size") % 2 == 0, _cat(', {"type": "', F.col("p_type"), '", "text": "lost"}')).otherwise("")
    return _contents(spark, d, _cat('"a", {"type": "mystery", "entries": ["dropped ', F.col("p_name"), '"]}', more, ', "b"'))


@query("""
SELECT p_partkey, 'a' || chr(10) || 'kept ' || p_name || chr(10) || 'inner ' || p_brand || chr(10) || '- {@x ' || p_type || '}' || chr(10) || '**Gallery:**' || chr(10) || 'b' AS content, 1 AS n_links, 0 AS ignored FROM part""")
def content_indexed(spark, d):
    """Containers without an id belong to the section around them; table cells stay as they are."""
    return _contents(spark, d, _cat('"a", {"type": "mystery", "entries": ["kept {@item ', F.col("p_name"), '}", {"type": "entries", "name": "no id", "entries": ["inner ', F.col("p_brand"), '"]}]}, {"type": "table", "rows": [["- {@x ', F.col("p_type"), '}"]]}, {"type": "gallery", "images": []}, "b"'), "indexed")


@query("""
SELECT p_partkey::VARCHAR AS doc_id, 's' AS node_id, 0 AS depth, p_name AS title, 'section' AS type, -1 AS page, 'a' || chr(10) || 'c' AS content FROM part
UNION ALL SELECT p_partkey::VARCHAR, '', 1, p_brand, 'inset', p_size, 'in' FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'deep', 2, 'Untitled Section', 'insetReadaloud', -1, p_type FROM part WHERE p_size % 2 = 0""")
def nested_sections(spark, d):
    deep = F.when(F.col("p_size") % 2 == 0, _cat(', {"type": "insetReadaloud", "id": "deep", "page": "x", "entries": ["', F.col("p_type"), '"]}')).otherwise("")
    entries = _cat('"a", {"type": "inset", "name": "', F.col("p_brand"), '", "page": ', F.col("p_size"), ', "entries": ["in"', deep, ']}, "c"')
    return flatten.flatten(_forms(spark, d, entries)).select("doc_id", "node_id", "depth", "title", "type", F.coalesce("page", S(-1)).alias("page"), "content")


@query("SELECT unnest(['section', 'list', 'mystery', 'image']) AS type UNION SELECT p_type FROM part WHERE p_size % 2 = 0")
def entry_types(spark, d):
    more = F.when(F.col("p_size") % 2 == 0, _cat(', {"a": {"type": "', F.col("p_type"), '"}}')).otherwise(', {"type": 4}')
    docs = _forms(spark, d, _cat('{"type": "list", "items": [{"type": "mystery"}, "type"]}, {"x": [[{"type": "image"}]]}', more))
    return flatten.entry_types(docs.unionByName(spark.createDataFrame([("bad", "{"), ("none", None)], "doc_id string, body string")))


@query(f"""
WITH s AS (SELECT 'section' AS t FROM region UNION ALL SELECT 'entries' FROM nation)
SELECT 'section' AS kind, t AS name, count(*) AS n FROM s GROUP BY ROLLUP (t) UNION ALL SELECT 'reference', t, count(*) FROM (SELECT 'creature' AS t FROM ({TREE})) GROUP BY ROLLUP (t)""")
def parsed_totals(spark, d):
    nodes = flatten.flatten(_tree_docs(spark, d), "indexed")
    return stats.parse_stats(nodes, flatten.external_refs(nodes))


# --- tags ---------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, repeat('<', p_size % 3) || p_name || ' of ' || p_brand || ' {' || p_type || '}' AS clean, 'creature:' || p_name || ':' || p_brand || CASE WHEN p_size % 14 > 0 THEN ';item:' || p_name || ' of ' || p_brand || ':' ELSE '' END AS links FROM part""")
def tags_nested(spark, d):
    """Tags in tags, up to fourteen deep, with plain braces beside them."""
    inner = _cat("{@creature ", F.col("p_name"), "|", F.col("p_brand"), "} of {@b ", F.col("p_brand"), "}")
    deep = F.concat(F.repeat(S("{@item "), F.col("p_size") % 14), inner, F.repeat(S("}"), F.col("p_size") % 14))
    text = F.concat(F.repeat(S("<"), F.col("p_size") % 3), deep, S(" {"), F.col("p_type"), S("}"))
    got = spread(_t(spark, d, "part")).select("p_partkey", text.alias("t")).select("p_partkey", tags.parse_and_clean(F.col("t")).alias("r"))
    listed = F.transform("r.links", lambda x: F.concat_ws(":", x["tag"], x["text"], F.array_join(x["attrs"], "|")))
    return got.select("p_partkey", "r.text", F.array_join(listed, ";").alias("links")).withColumnRenamed("text", "clean")


@query("""
SELECT p_partkey, '{@note ' || p_name || ' and ' || p_brand || '}' AS clean, 'b|{@b ' || p_name || '};item|{@item ' || p_brand || '|X}' AS links FROM part""")
def tags_single_pass(spark, d):
    got = spread(_t(spark, d, "part")).select("p_partkey", tags.parse_once(_cat("{@note {@b ", F.col("p_name"), "} and {@item ", F.col("p_brand"), "|X}}")).alias("r"))
    listed = F.array_join(F.transform("r.links", lambda x: F.concat_ws("|", x["tag"], x["raw"])), ";")
    return got.select("p_partkey", F.col("r.text").alias("clean"), listed.alias("links"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'A' || p_size WHEN 1 THEN 'c' || p_size WHEN 2 THEN 'D' || p_size ELSE '' END AS code FROM part")
def area_codes(spark, d):
    title = F.when(F.col("p_size") % 5 == 0, _cat("A", F.col("p_size"), ": ", F.col("p_name"))).when(F.col("p_size") % 5 == 1, _cat("area  c", F.col("p_size"), ":", F.col("p_name"))).when(F.col("p_size") % 5 == 2, _cat("D", F.col("p_size"), " ", F.col("p_name"))).when(F.col("p_size") % 5 == 3, _cat("AB", F.col("p_size"), ": ", F.col("p_name"))).otherwise(_cat("A", F.col("p_size"), ". ", F.col("p_name")))
    return _t(spark, d, "part").select("p_partkey", T.area_code(title).alias("code"))


# --- sections -----------------------------------------------------------------------------------


def _places(spark, d) -> DataFrame:
    """Regions, nations and customers as sections of one document a region."""
    r, n, c = (_t(spark, d, x) for x in ("region", "nation", "customer"))
    key = lambda x: F.col(x).cast("int")
    link = lambda text, tag: F.array(F.struct(text.alias("text"), S(tag).alias("tag"), F.array().cast("array<string>").alias("attrs")))
    section = lambda df, path, parent, depth, node, title, kind, content, links: df.select(_id("r", path[0]).alias("doc_id"), F.array(*map(key, path)).alias("path"), F.array(*map(key, parent)).cast("array<int>").alias("parent_path"), S(depth).alias("depth"), node.alias("node_id"), title.alias("title"), S(kind).alias("type"), content.alias("content"), links.alias("links"))
    a = section(r, ["r_regionkey"], [], 0, _id("r", "r_regionkey"), F.col("r_name"), "region", S(""), link(F.col("r_name"), "area"))
    b = section(n, ["n_regionkey", "n_nationkey"], ["n_regionkey"], 1, _id("n", "n_nationkey"), F.col("n_name"), "nation", F.col("n_name"), link(F.lower("n_name"), "creature"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    e = section(j, ["n_regionkey", "n_nationkey", "c_custkey"], ["n_regionkey", "n_nationkey"], 2, F.lower("c_mktsegment"), F.col("c_name"), "customer", F.concat_ws("\n", "c_name", "c_mktsegment"), link(F.col("n_name"), "creature"))
    return a.unionByName(b).unionByName(e)


PLACES_SQL = """
SELECT 'r' || r_regionkey AS doc_id, [r_regionkey] AS path, 0 AS depth, 'r' || r_regionkey AS node_id, r_name AS title, 'region' AS type, '' AS content, r_name AS link, 'area' AS tag FROM region
UNION ALL SELECT 'r' || n_regionkey, [n_regionkey, n_nationkey], 1, 'n' || n_nationkey, n_name, 'nation', n_name, lower(n_name), 'creature' FROM nation
UNION ALL SELECT 'r' || n_regionkey, [n_regionkey, n_nationkey, c_custkey::INT], 2, lower(c_mktsegment), c_name, 'customer', c_name || chr(10) || c_mktsegment, n_name, 'creature' FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"SELECT doc_id, node_id, title, row_number() OVER (ORDER BY doc_id, path) AS rank FROM ({PLACES_SQL})")
def sections_in_preorder(spark, d):
    return ranks.numbered(traverse.preorder(_places(spark, d)).select("doc_id", "node_id", "title"))


@query(f"SELECT doc_id, node_id, title, row_number() OVER (ORDER BY doc_id, list_append(path, 2147483647)) AS rank FROM ({PLACES_SQL})")
def sections_in_postorder(spark, d):
    return ranks.numbered(traverse.postorder(_places(spark, d)).select("doc_id", "node_id", "title"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 1000")
def sections_longer_than(spark, d):
    return traverse.longer_than(_t(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 1000).select("doc_id", F.length("content").cast("long").alias("n"))


@query(f"SELECT doc_id, title FROM ({PLACES_SQL}) WHERE type = 'nation'")
def sections_of_type(spark, d):
    return traverse.by_type(_places(spark, d), "nation").select("doc_id", "title")


@query(f"SELECT doc_id, arg_min(title, path) AS title, arg_min(content, path) AS content FROM ({PLACES_SQL}) WHERE node_id = 'building' GROUP BY doc_id")
def section_of_id(spark, d):
    """Many sections have the id; each document's first one is found."""
    return traverse.by_id(_places(spark, d), "building").select("doc_id", "title", "content")


@query(f"SELECT type, count(*) AS n FROM ({PLACES_SQL}) GROUP BY type")
def section_counts(spark, d):
    return traverse.count_by_type(_places(spark, d))


@query(f"SELECT doc_id, title FROM ({PLACES_SQL}) WHERE lower(link) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7)")
def sections_mentioning(spark, d):
    name = _t(spark, d, "nation").where("n_nationkey = 7").first().n_name
    return traverse.mentions(_places(spark, d), name.swapcase()).select("doc_id", "title")


@query(f"SELECT 'below' AS part, title FROM ({PLACES_SQL}) WHERE path[1] = 1 AND path[2] = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'shallow', title FROM ({PLACES_SQL}) WHERE path[1] = 1 AND depth <= 1 UNION ALL SELECT 'root', title FROM ({PLACES_SQL}) WHERE depth = 0")
def section_subtrees(spark, d):
    nodes = _places(spark, d)
    nation = _t(spark, d, "nation").where("n_regionkey = 1").agg(F.min("n_nationkey")).first()[0]
    part = lambda df, name: df.select(S(name).alias("part"), "title")
    return part(traverse.subtree(nodes, "r1", [1, nation], 1), "below").unionByName(part(traverse.subtree(nodes, "r1", [], 1), "shallow")).unionByName(part(traverse.roots(nodes), "root"))


@query(f"SELECT doc_id, node_id, title, type, (tag = 'creature')::INT AS n_entity, (tag = 'area')::INT AS n_navigation, 0 AS n_mechanic, substr(split_part(content, chr(10), 1), 1, 12) AS paragraph, CASE WHEN content LIKE '%' || chr(10) || '%' THEN 2 ELSE 1 END AS n_paragraphs FROM ({PLACES_SQL})")
def section_cards(spark, d):
    return traverse.cards(_places(spark, d), paragraphs=2, chars=12).select("doc_id", "node_id", "title", "type", "n_entity", "n_navigation", "n_mechanic", F.get("paragraphs", 0).alias("paragraph"), F.size("paragraphs").alias("n_paragraphs"))


@query(f"""
WITH e AS (SELECT doc_id, path, node_id AS id, title AS label FROM ({PLACES_SQL}) WHERE depth > 0),
u AS (SELECT doc_id, path[1 : i] AS up, path, id, label FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM e))
SELECT doc_id, array_to_string(up, '.') AS section, id, arg_min(label, path) AS label FROM u GROUP BY doc_id, up, id""")
def accumulated_entities(spark, d):
    own = _places(spark, d).where("depth > 0").select("doc_id", "path", F.col("node_id").alias("id"), F.col("title").alias("label"), S(0).alias("ord"))
    return traverse.accumulated(own).select("doc_id", F.array_join("at", ".").alias("section"), "id", "label")


@query("""
SELECT 'r' || r_regionkey AS doc_id, r_name AS root, n.n AS n_nations, n.first AS first_nation, c.n AS n_customers, c.last AS last_customer FROM region
JOIN (SELECT n_regionkey, count(*) AS n, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY 1) n ON n.n_regionkey = r_regionkey
JOIN (SELECT n_regionkey, count(*) AS n, arg_max(c_name, n_nationkey * 10000000 + c_custkey) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) c ON c.n_regionkey = r_regionkey""")
def section_trees(spark, d):
    """The flat sections as nested documents, read back by their nesting."""
    leaf = "struct<title: string, children: array<string>>"
    tree = f"array<struct<title: string, children: array<struct<title: string, children: array<{leaf}>>>>>"
    got = traverse.trees(_places(spark, d)).select("doc_id", F.from_json("body", tree).alias("t")).select("doc_id", F.get("t", 0).alias("r"))
    leaves = F.flatten(F.transform("r.children", lambda x: x["children"]))
    return got.select("doc_id", F.col("r.title").alias("root"), F.size("r.children").cast("long").alias("n_nations"), F.get("r.children", 0)["title"].alias("first_nation"), F.size(leaves).cast("long").alias("n_customers"), F.element_at(leaves, -1)["title"].alias("last_customer"))


# --- names --------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, replace(lower(p_name), ' ', '_') AS suggested, replace(replace(lower(p_name || '''s ' || p_type), ' ', '_'), '''', '') AS default_id,
 CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'Old_' END || CASE WHEN p_size % 3 = 2 THEN 'Mill' ELSE '' END AS label FROM part""")
def default_names(spark, d):
    p = _t(spark, d, "part")
    label = F.when(F.col("p_size") % 3 == 0, _cat(" ", F.col("p_name"), " ")).otherwise(" ")
    aliases = F.when(F.col("p_size") % 3 == 1, F.array(_cat("'", F.col("p_brand"), "'"))).otherwise(F.array().cast("array<string>"))
    named = T.default_label(label, aliases, S("old_mill"))
    return p.select("p_partkey", T.suggested_id(F.col("p_name")).alias("suggested"), T.default_id(_cat(F.col("p_name"), "'s ", F.col("p_type"))).alias("default_id"), F.when(F.col("p_size") % 3 == 2, F.replace(named, S(" "), S("_"))).otherwise(named).alias("label"))


@query("SELECT DISTINCT p_name, unnest([lower(p_name) || ' of ' || lower(p_type), lower(p_name), lower(split_part(p_name, ' ', 2)) || ' of', 'of ' || lower(p_type)]) AS alias FROM part WHERE p_name LIKE '% %'")
def alias_forms(spark, d):
    p = _t(spark, d, "part").where("p_name LIKE '% %'")
    return p.select("p_name", F.explode(T.alias_forms(F.concat_ws("_of ", F.col("p_name"), F.col("p_type")))).alias("alias")).distinct()


@query("""
WITH k AS (SELECT 'p' || p_partkey AS id, p_partkey AS ord, unnest([lower(p_name), lower(p_brand || ' ' || p_type)]) AS alias FROM part)
SELECT alias, arg_max(id, ord) AS id FROM k GROUP BY alias""")
def alias_map(spark, d):
    from ..operators import canonical

    p = _t(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.array(F.concat_ws("_", F.col("p_brand"), F.col("p_type")), S(" ")).alias("aliases"), F.col("p_partkey").alias("ord"))
    return canonical.alias_map(p)


@query("""
SELECT DISTINCT kind, CASE lower(kind) WHEN 'creature' THEN 'Creature' WHEN 'item' THEN 'Item' WHEN 'spell' THEN 'Spell' WHEN 'location' THEN 'Location' WHEN 'party' THEN 'Party' ELSE 'Entity' END AS label
FROM (SELECT unnest([event_type, 'Creature', 'ITEM', 'spell', 'Location', 'party', 'unknown']) AS kind FROM events)""")
def type_labels(spark, d):
    kinds = _t(spark, d, "events").select(F.explode(F.array("event_type", *(S(x) for x in ("Creature", "ITEM", "spell", "Location", "party", "unknown")))).alias("kind")).distinct()
    return kinds.select("kind", T.type_label(F.col("kind")).alias("label"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x' || text || 'y' WHEN 1 THEN '<think>' || text ELSE '<think>a</think> ' END AS rest FROM conversations WHERE text NOT LIKE '%<think>%' AND text = trim(text) AND text <> ''""")
def thinking_stripped(spark, d):
    c = _t(spark, d, "conversations").where("text NOT LIKE '%<think>%' AND text = trim(text) AND text <> ''")
    kind = F.col("turn") % 4
    text = F.when(kind == 0, _cat("<think>a\n</think>x", F.col("text"), "<think>b</think>y")).when(kind == 1, _cat("<think>", F.col("text"))).otherwise("<think>a</think> ")
    return c.select("conv_id", "turn", T.strip_thinking(text).alias("rest"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"a": "' || p_name || '"}' WHEN 1 THEN '{"b": {"c": ' || p_size || '}}' END AS body FROM part""")
def json_salvaged(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, _cat("Here: ```json\n{broken\n``` and ```\n", '{"a": "', F.col("p_name"), '"}', "\n``` done {x}")).when(F.col("p_size") % 3 == 1, _cat('So {"b": {"c": ', F.col("p_size"), "}} it is")).otherwise(_cat("No {json of ", F.col("p_name"), "} here"))
    return _t(spark, d, "part").select("p_partkey", F.regexp_replace(T.salvage_json(text), r"\s+$", "").alias("body"))


@query("""
SELECT p_partkey, '- ' || p_name || ' (ID: p' || p_partkey || ', Type: ' || p_type || ')' AS node, '- ' || p_name || ' --[made_by]--> ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END AS edge FROM part""")
def prompt_lines(spark, d):
    desc = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")
    return _t(spark, d, "part").select("p_partkey", T.node_line(F.col("p_name"), _id("p", "p_partkey"), F.col("p_type")).alias("node"), T.edge_line(F.col("p_name"), S("made_by"), F.col("p_brand"), desc).alias("edge"))


@query("""
SELECT p_partkey, replace(replace(replace(replace(replace(p_name || ' <&>"''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, 25 + least(p_size * 3, 60) AS size,
 CASE WHEN length(p_name || p_name) > greatest(4, floor((25 + least(p_size * 3, 60)) / 3.5)) THEN substr(p_name || p_name, 1, greatest(4, floor((25 + least(p_size * 3, 60)) / 3.5))::INT) || '..' ELSE p_name || p_name END AS shown,
 greatest(1.0, least(p_size / 3.0, 10.0))::DOUBLE AS width FROM part""")
def display_formats(spark, d):
    size = T.node_size(F.col("p_size"))
    return _t(spark, d, "part").select("p_partkey", T.html_escape(_cat(F.col("p_name"), " <&>\"'")).alias("escaped"), size.alias("size"), T.display_label(F.concat(F.col("p_name"), F.col("p_name")), size).alias("shown"), T.edge_width(F.col("p_size") / 3).alias("width"))


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'creatures' WHEN 1 THEN 'locations' WHEN 2 THEN 'items' WHEN 3 THEN 'creatures' ELSE 'unknown' END AS kind, CASE p_size % 6 WHEN 0 THEN '#d9b8f1' WHEN 1 THEN '#f1b8f1' WHEN 2 THEN '#b8f1ed' WHEN 3 THEN '#b8f1cc' ELSE '#34CAF7' END AS colour FROM part""")
def label_kinds(spark, d):
    pick = lambda *names: F.when(F.col("p_size") % 6 == 0, names[0]).when(F.col("p_size") % 6 == 1, names[1]).when(F.col("p_size") % 6 == 2, names[2]).when(F.col("p_size") % 6 == 3, names[3]).otherwise(names[4])
    label = F.concat_ws(" ", "p_partkey", pick("Young DRAGON", "East Tower", "crystal ball", "kobold cave", "qqq"))
    return _t(spark, d, "part").select("p_partkey", T.label_kind(label).alias("kind"), T.node_colour(pick("monster", "sub_location", "MAGIC ITEM", "event", "zzz")).alias("colour"))


@query("""
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'empty id' WHEN 1 THEN 'id is not snake case' WHEN 2 THEN 'unknown entity type' WHEN 3 THEN 'unknown event type' WHEN 6 THEN 'unknown entity type' END AS reason FROM part""")
def invalid_nodes(spark, d):
    own = _cat("p_", F.col("p_partkey"))
    node = F.when(F.col("p_size") % 7 == 0, " ").when(F.col("p_size") % 7 == 1, _cat("P-", F.col("p_partkey"))).otherwise(own)
    kind = F.when(F.col("p_size") % 7 == 3, "event").when(F.col("p_size") % 7 == 5, "event").otherwise("entity")
    of = F.when(F.col("p_size") % 7 == 2, "Spell").when(F.col("p_size") % 7 == 3, "Location").when(F.col("p_size") % 7 == 5, "quest").when(F.col("p_size") % 7 == 6, S(None).cast("string")).otherwise("Item")
    return _t(spark, d, "part").select("p_partkey", T.invalid_reason(node, kind, of).alias("reason"))


#: Ids and labels that stand for nothing, each beside one that does.
_EMPTY = [f"{x}_7" for x in ("location", "adventure_location", "loc", "zone", "region", "section", "area_b", "entity", "node", "object", "item", "thing", "placeholder", "temp", "unknown")]
_EMPTY = [x.replace("area_b_", "area_b") for x in _EMPTY] + ["location7", "area7", "loc7", "zone7", "region7", "section7", "adventure_location7", "adventure_locations", "unknown_entities", "unknown_locations", "generic_entities", "miscellaneous_entities", "other_entities", "various_locations", "several_locations", "multiple_entities"]
_FULL = ["area_7", "entity7", "item7", "a_location_7", "location_7a", "many_entities", "region_x", "temp_"]
_EMPTY_LABELS = ["a location", "an area", "A Place", " a spot ", "an region", "a zone", "unknown entity", "Generic object", "unspecified area", "unnamed location"]
_FULL_LABELS = ["the location", "a place of rest", "unknown spot", "generic", "named entity"]
_VALUES = ", ".join([*(f"('{x}', 'Bell', true), (upper('{x}'), 'Bell', true)" for x in _EMPTY), *(f"('{x}', 'Bell', false)" for x in _FULL), *(f"('bell', '{x}', true)" for x in _EMPTY_LABELS), *(f"('bell', '{x}', false)" for x in _FULL_LABELS), "('bell', NULL, false)"])


@query(f"WITH v(id, label, empty) AS (VALUES {_VALUES}) SELECT id, label, empty, count(*) AS n FROM v, part GROUP BY ALL")
def meaningless_patterns(spark, d):
    rows = [r for x in _EMPTY for r in ((x, "Bell"), (x.upper(), "Bell"))] + [(x, "Bell") for x in _FULL] + [("bell", x) for x in (*_EMPTY_LABELS, *_FULL_LABELS, None)]
    each = _t(spark, d, "part").select(F.explode(F.array(*(F.struct(S(i).alias("id"), S(x).cast("string").alias("label")) for i, x in rows))).alias("v")).select("v.*")
    return each.select("id", "label", T.is_meaningless(F.col("id"), F.col("label")).alias("empty")).groupBy("id", "label", "empty").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT 0 AS term_id, 'the' AS term UNION ALL SELECT 1, 'de ' UNION ALL SELECT 2, 'on'), x AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, 'İİ' || text FROM benchmark),
f AS (SELECT doc_id, text, term_id, term, strpos(lower(text), term) - 1 AS begun FROM x JOIN t ON contains(lower(text), term))
SELECT doc_id, term_id::BIGINT AS term_id, ((length(text) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS n, begun::BIGINT AS "at", substr(text, greatest(begun - 30, 0)::INT + 1, (begun + length(term) + 30 - greatest(begun - 30, 0))::INT) AS context FROM f""")
def term_search(spark, d):
    """Terms in the documents, and in the benchmark's texts behind two letters that are longer in lower case."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = docs.unionByName(_t(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.concat(S("İİ"), "text").alias("text")))
    return containment.occurrences(docs, [(0, "THE"), (1, "de "), (2, "on"), (3, "")]).withColumnRenamed("id", "doc_id")


# --- replies ------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT p_partkey, 0 AS i, 'p_' || p_partkey AS id, p_name AS label, p_type AS type, p_brand || ';x' AS aliases, p_size % 2 = 0 AS is_generic, NULL AS place FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 1, replace(lower(p_brand || '''s hall'), ' ', '_'), p_brand || '''s hall', 'Entity', '', false, 'building' FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT p_partkey, 2, 'old_mill', 'Old Mill', 'Entity', '', false, NULL FROM part WHERE p_size % 5 <> 0)
SELECT p_partkey, i, replace(id, '''', '') AS id, label, type, aliases, is_generic, place FROM e""")
def parse_entities(spark, d):
    text = _cat("Sure!\n<entities>\nEntity: ", F.col("p_name"), "\nType: ", F.col("p_type"), "\nID: p_", F.col("p_partkey"), "\nAliases: [", F.col("p_brand"), ", x ,]\nIsGeneric: ", F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no"), "\nEntity: ", F.col("p_brand"), "'s hall\nLocationType: building\n\nEntity:\nID: old_mill\nEntity:\nAliases: gone\n</entities>\nEntity: outside")
    text = F.when(F.col("p_size") % 5 == 0, _cat("<summary>nothing</summary>", text)).otherwise(text)
    got = _t(spark, d, "part").select("p_partkey", F.posexplode(parsers.entities(text)).alias("i", "e"))
    return got.select("p_partkey", "i", "e.id", "e.label", "e.type", F.array_join("e.aliases", ";").alias("aliases"), "e.is_generic", F.col("e.location_type").alias("place"))


@query("""
SELECT event_id, 0 AS i, 'e' || event_id AS id, 'The ' || event_type AS label, 'combat' AS type, 'u' || user_id || ';b' AS participants, 'k' || json_extract_string(props, '$.k') AS location, 'at: dawn' AS description FROM events
UNION ALL SELECT event_id, 1, event_type || '_no_' || event_id, event_type || ' no. ' || event_id, 'encounter', '', NULL, '' FROM events""")
def parse_events(spark, d):
    head = F.when(F.col("event_id") % 3 == 0, "<events>\n").when(F.col("event_id") % 3 == 1, "so\n<events>").otherwise("")
    tail = F.when(F.col("event_id") % 3 == 0, "\n</events>\nEvent: outside").otherwise("")
    text = _cat(head, "\nEvent: The ", F.col("event_type"), "\nID: e", F.col("event_id"), "\nType: COMBAT\nParticipants: [u", F.col("user_id"), ", b]\nLocation: k", F.get_json_object("props", "$.k"), "\nDescription: at: dawn\n\nEvent: ", F.col("event_type"), " no. ", F.col("event_id"), tail)
    got = _t(spark, d, "events").select("event_id", F.posexplode(parsers.events(text)).alias("i", "e"))
    return got.select("event_id", "i", "e.id", "e.label", "e.type", F.array_join("e.participants", ";").alias("participants"), "e.location", "e.description")


@query("SELECT p_partkey, p_size % 3 = 0 AS is_complete, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || ';' || p_brand END AS missing, p_type AS issues FROM part")
def parse_reports(spark, d):
    found = F.when(F.col("p_size") % 3 == 0, "").otherwise(_cat("- ", F.col("p_name"), "\n  -- ", F.col("p_brand"), "\n"))
    text = _cat("Is Complete: ", F.when(F.col("p_size") % 3 == 0, "YES").otherwise("No"), "\n- stray\nMissing Locations:\n", found, "\nIssues found:\nnone\n- ", F.col("p_type"), "\n")
    got = _t(spark, d, "part").select("p_partkey", text.alias("reply")).select("p_partkey", parsers.report("reply").alias("r"))
    return got.select("p_partkey", "r.is_complete", F.array_join("r.missing_locations", ";").alias("missing"), F.array_join("r.issues", ";").alias("issues"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || ',' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_brand || ',' || p_brand ELSE '' END AS ids FROM part")
def parse_location_answers(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, _cat('{"location_ids": ["', F.col("p_name"), '", "', F.col("p_brand"), '"], "location_id": "x"}')).when(F.col("p_size") % 5 == 1, _cat('{"location_id": "', F.col("p_name"), '"}')).when(F.col("p_size") % 5 == 2, _cat('{"location_id": ["', F.col("p_brand"), '", "', F.col("p_brand"), '"]}')).when(F.col("p_size") % 5 == 3, '{"location_ids": null}').otherwise("not json")
    return _t(spark, d, "part").select("p_partkey", F.array_join(parsers.location_ids(text), ",").alias("ids"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name WHEN 2 THEN '' ELSE p_brand END AS found FROM part""")
def parse_unified(spark, d):
    """Entities and events of one reply: both, entities alone, a summary, an open block of events."""
    some = _cat("<entities>\nEntity: ", F.col("p_name"), "\n</entities>\n")
    text = F.when(F.col("p_size") % 4 == 0, _cat(some, "<events>\nEvent: ", F.col("p_brand"), "\n</events>")).when(F.col("p_size") % 4 == 1, some).when(F.col("p_size") % 4 == 2, _cat("<summary>x</summary>", some)).otherwise(_cat("<events>\nEvent: ", F.col("p_brand")))
    got = _t(spark, d, "part").select("p_partkey", parsers.unified(text).alias("r"))
    return got.select("p_partkey", F.concat_ws("|", F.transform("r.entities", lambda x: x["label"]), F.transform("r.events", lambda x: x["label"])).alias("found"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY (l_orderkey % 11)::VARCHAR, [l_partkey % 13, l_suppkey % 17], l_orderkey, l_linenumber, l_partkey) AS ord FROM lineitem")
def entity_order(spark, d):
    """Entities in the order of documents, paths and places: 10 comes after 9 in a path."""
    from . import stages

    i = _t(spark, d, "lineitem")
    path = F.array((F.col("l_partkey") % 13).cast("int"), (F.col("l_suppkey") % 17).cast("int"))
    rows = i.select((F.col("l_orderkey") % 11).cast("string").alias("doc_id"), path.alias("path"), "l_orderkey", "l_linenumber", "l_partkey")
    return stages.in_document_order(rows, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "ord")
