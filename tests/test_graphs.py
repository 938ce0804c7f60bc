import json
import random

import pytest
from pyspark.sql import functions as F

from tomegraph.functions import containment
from tomegraph.functions import similarity as S
from tomegraph.operators import canonical, evaluate, graph, hetero, metrics, parsers, paths, resolve, search, stats, views
from tomegraph.plans import context, queries
from tomegraph.plans.client import RuleClient
from tomegraph.sources import catalogs, documents, graphs, sinks

N = "id string, label string, type string, ord long"
E = "source string, target string, relation string, desc string, ord long"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), N)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "", i) if len(r) == 3 else r for i, r in enumerate(rows)], E)


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_deduplication(spark):
    n = nodes(spark, ("a", "x", "1", 1), ("b", "bb", "1", 2), ("a", "yyy", "2", 3), ("a", "zzz", "3", 4), ("c", "c", "1", 5))
    assert keys(graph.longest_label(n), "ord", "id", "label", "type") == [(1, "a", "yyy", "2"), (2, "b", "bb", "1"), (5, "c", "c", "1")]
    assert keys(graph.upgraded_label(n), "ord", "id", "label", "type") == [(1, "a", "yyy", "1"), (2, "b", "bb", "1"), (5, "c", "c", "1")]
    assert keys(graph.last_wins(n, ["id"]), "id", "label") == [("a", "zzz"), ("b", "bb"), ("c", "c")]
    assert graph.longest_label(n.limit(0)).count() == 0


def test_remap(spark):
    e = edges(spark, ("a", "b", "r1"), ("a", "b", "r1"), ("a", "b", "r2"), ("b", "c", "r"), ("c", "a", "r"))
    m = spark.createDataFrame([("c", "b")], "old_id string, new_id string")
    n = nodes(spark, ("a", "a", "t", 0), ("b", "b", "t", 1), ("c", "ccc", "t", 2))
    got_n, got_e = graph.remap(n, e, m)
    assert keys(got_e, "source", "target", "relation") == [("a", "b", "r1"), ("a", "b", "r2"), ("b", "a", "r")]
    assert keys(got_n, "id", "label") == [("a", "a"), ("b", "ccc")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "old_id string, new_id string")
    assert keys(graph.transitive(chain), "old_id", "new_id") == [("a", "d"), ("b", "d"), ("c", "d")]


def test_merge_and_delete(spark):
    n, e = nodes(spark, ("a", "a", "t", 0), ("b", "b", "u", 1)), edges(spark, ("a", "b", "r"), ("b", "zz", "r"))
    merged = graph.merge([(n, e), (nodes(spark, ("a", "aaa", "t", 0)), edges(spark, ("a", "b", "r")))])
    assert keys(merged[0], "id", "label") == [("a", "aaa"), ("b", "b")]
    assert merged[1].count() == 2
    assert keys(graph.induced(n, e), "source", "target") == [("a", "b")]
    assert keys(graph.dangling(n, e), "id") == [("zz",)]
    left = sinks.delete_by_label(n, e, "u")
    assert keys(left[0], "id") == [("a",)]
    assert left[1].count() == 0
    with pytest.raises(ValueError, match="confirm"):
        sinks.delete_all(n, e)
    with pytest.raises(ValueError, match="not unique"):
        sinks.assert_unique(n.union(n), ["id"])
    _, up_e, counts = sinks.upsert_graph((n, e.limit(0)), (n, e))
    assert counts == {"nodes": 2, "edges": 1}
    assert up_e.count() == 1


def test_retrieval(spark):
    e = edges(spark, ("u", "v", "r"), ("v", "w", "r"), ("u", "w", "r"), ("x", "u", "r"))
    seed = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, seed_ord int")
    assert keys(paths.ego_edges(e, seed("u"), 1), "source", "target") == [("u", "v"), ("u", "w"), ("v", "w")]
    assert keys(paths.ego_edges(e, seed("u", "v"), 1), "source", "target", "seed_ord") == [("u", "v", 0), ("u", "w", 0), ("v", "w", 0)]
    ids = seed("x", "w").select("id")
    got = {(r.start, r.end): r.path for r in paths.paths(e, ids, ids, 3).collect()}
    assert got == {("x", "w"): ["x", "u", "w"]}
    both = {(r.start, r.end): len(r.path) for r in paths.paths(e, ids, ids, 5, undirected=True).collect()}
    assert both == {("x", "w"): 3, ("w", "x"): 3}
    n = nodes(spark, *((x, x.upper(), "t", i) for i, x in enumerate("uvwx")))
    emb = search.embedded(n, "label", search.HashingEmbedder(64))
    query = [float(x) for x in search.HashingEmbedder(64).embed(["U"])[0]]
    text = context.retrieve(emb, e, query, top_k=1)
    assert "- U --[r]--> V" in text.split("\n")
    assert context.retrieve(emb.limit(0), e, query) == context.NOTHING
    assert context.answer("q", text, RuleClient())["answer"]
    history = spark.createDataFrame([], "query string, answer string, context string, prompt string, n_prompt int, n_context int")
    assert context.append_history(history, context.answer("q", text)).count() == 1


def test_metrics(spark):
    e = edges(spark, ("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r"), ("e", "e", "r"))
    n = nodes(spark, *((x, x, "t", i) for i, x in enumerate("abcde")))
    assert keys(metrics.components(n, e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e")]
    got = {r.id: (r.degree, r.triangles, round(r.coefficient, 3)) for r in metrics.clustering(e).collect()}
    assert got == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (3, 1, 0.333), "d": (1, 0, 0.0)}
    assert metrics.diameter(n.where("id <> 'e'"), e) == 2
    assert metrics.diameter(n, e) is None
    r = random.Random(5)
    for size, extra in ((1, 0), (12, 0), (30, 8), (25, 60)):
        links = [(r.randrange(i) if extra else i - 1, i) for i in range(1, size)] + [(r.randrange(size), r.randrange(size)) for _ in range(extra)]
        near = {i: {b for a, b in links + [(b, a) for a, b in links] if a == i} for i in range(size)}

        def far(i):
            seen, now, d = {i}, {i}, 0
            while now := {b for a in now for b in near[a]} - seen:
                seen |= now
                d += 1
            return d

        g = spark.createDataFrame([(str(i),) for i in range(size)], "id string"), spark.createDataFrame([(str(a), str(b)) for a, b in links], "source string, target string")
        assert metrics.diameter(*g) == max(map(far, range(size)))
    assert keys(stats.degrees(e), "id", "degree")[-1] == ("e", 2)
    assert keys(stats.degrees(e, loops_once=True), "id", "degree")[-1] == ("e", 1)
    assert stats.density(n.where("id = 'a'"), e.limit(0)).first().density == 0
    bad = edges(spark, ("<unknown>", "b", "r"), ("a", "null", "r"), ("a", "b", "r"))
    assert metrics.clean_relations(bad).count() == 1


def test_diameter_of_alike_nodes_takes_few_rounds(spark, monkeypatch):
    """A ring (no node can be left out), and customers that hang on the same two nodes (one stands for all)."""
    rounds = []
    distances = metrics.distances
    monkeypatch.setattr(metrics, "distances", lambda both, starts: rounds.append(starts.count()) or distances(both, starts))
    graph_ = lambda pairs: (spark.createDataFrame(sorted({(x,) for p in pairs for x in p}), "id int"), spark.createDataFrame(pairs, "source int, target int"))
    assert metrics.diameter(*graph_([(i, (i + 1) % 13) for i in range(13)])) == 6
    assert sum(rounds) <= 13 and len(rounds) <= 2
    rounds.clear()
    hubs = [(100 + i, k) for i in range(60) for k in (i % 3, 3 + i % 2)]
    assert metrics.diameter(*graph_(hubs)) == 4
    assert sum(rounds) <= 11 and len(rounds) <= 2
    rounds.clear()
    assert metrics.diameter(*graph_([(1, 2), (1, 3), (4, 5), (4, 6)])) is None
    assert metrics.diameter(*graph_([(1, 2), (1, 3)])) == 2


def test_views(spark):
    n = nodes(spark, ("location:a", "A", "location", 0), ("b", "B", "npc", 1))
    e = edges(spark, ("location:a", "b", "r"))
    assert keys(views.drawn(n, e), "id", "degree", "colour") == [("b", 1, "#f1ccb8"), ("location:a", 1, "#f1b8f1")]
    c = views.combined((n, e), (nodes(spark, ("a", "AA", "Location", 0)), edges(spark, ("a", "b", "q"))))
    assert keys(c[0], "id", "label") == [("a", "A"), ("b", "B")]
    assert keys(c[1], "source", "target", "relation") == [("a", "b", "q"), ("a", "b", "r")]
    assert [r.type for r in views.filter_types(n).collect()] == ["Location", "Npc"]
    assert views.preset(n, e, "locations")[0].count() == 1
    assert views.by_filters(n.withColumn("node_type", F.lit("entity")), e, ["location", "event"])[0].count() == 1
    assert "<\\/script>" in sinks.network_html([{"id": "</script>"}], [])


def test_hetero(spark):
    ev = spark.createDataFrame([("e1", "E1", "combat", ["a", "zz", ""], "den", "", 0), ("e2", "E2", "combat", [""], None, "", 1), ("e3", "E3", "party", ["a"], None, "", 2)], "id string, label string, type string, participants array<string>, location string, description string, ord long")
    n = nodes(spark, ("a", "Ann", "Creature", 0), ("den", "Den", "Location", 1), ("location_1", "x", "Location", 2))
    m = spark.createDataFrame([("zz", "a")], "old_id string, new_id string")
    got_n, got_e = hetero.assemble(n, ev, edges(spark, ("a", "den", "in")), m)
    assert {r.id: r.invalid_reason for r in got_n.collect()} == {"a": None, "den": None, "e1": None, "e3": "unknown event type"}
    assert keys(got_e, "source", "target", "relation") == [("a", "den", "in"), ("e1", "a", "has_participant"), ("e1", "den", "occurs_at"), ("e3", "a", "has_participant")]
    assert {r.desc for r in hetero.event_edges(ev).where("relation = 'occurs_at'").collect()} == {"combat at this location"}


def test_graph_files(spark, tmp_path):
    body = {"nodes": [{"id": "a", "label": "A", "type": "t"}, {"id": "a", "label": "A2"}], "edges": [{"source": "a", "target": "b", "relation": "x"}, {"source": "a", "target": "b", "relationship": "y"}]}
    (tmp_path / "g.json").write_text(json.dumps(body))
    n, e = graphs.load_graph(spark, f"file://{tmp_path}/g.json")
    assert keys(n, "id", "ord") == [("a", 0), ("b", 1 << 40)]
    assert {r.id: (r.label, r.type) for r in n.collect()}["a"] == ("A2", "unknown")
    assert keys(e, "source", "target", "relation") == [("a", "b", "y")]
    assert documents.projects(spark, f"file://{tmp_path}") == ["g"]
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, f"file://{tmp_path}/no.json")
    (tmp_path / "l.txt").write_text("# c\n\nBell\n Lamp Post \n")
    assert keys(documents.read_labels(spark, f"file://{tmp_path}/l.txt"), "name", "line_no") == [("Bell", 3), ("Lamp Post", 4)]


CATALOG = [(0, "Marsh Wolf", "ABC"), (1, "marsh wolf", "DEF"), (2, "Great Marsh Wolf", "ABC"), (3, "Lamp", "XYZ")]


@pytest.mark.parametrize(("kind", "name", "source", "want"), [
    ("creature", "Marsh Wolf", "DEF", (2, 0)), ("creature", "marsh wolf", "DEF", (1, 1)), ("creature", "MARSH WOLF", None, (3, 0)), ("creature", "Great Marsh", None, (4, 2)),
    ("creature", "the Lamp of old", None, (4, 3)), ("creature", "Unseen", "Q", (None, None)), ("item", "lam", None, (4, 3)), ("item", "the Lamp of old", None, (None, None)), ("spell", "lamp", "?", (3, 3)), ("spell", "lam", None, (None, None)),
])
def test_tiers(spark, kind, name, source, want):
    c = spark.createDataFrame(CATALOG, "ord long, name string, source string")
    r = spark.createDataFrame([("r", name, source)], "ref_id string, name string, source string")
    got = resolve.match(r, c, kind).first()
    assert (got.tier, got.matched_ord) == want


def test_inheritance(spark):
    parent = {"name": "P", "source": "S", "text": "the wolf runs", "action": [{"name": x} for x in "ABC"], "_x": 1, "environment": ["no"]}
    mod = {"*": {"mode": "replaceTxt", "replace": "THE WOLF", "with": "Rex", "flags": "i"}, "action": [{"mode": "removeArr", "names": "A"}, {"mode": "replaceArr", "replace": "B", "items": {"name": "B2"}}, {"mode": "appendArr", "items": {"name": "D"}}]}
    child = {"name": "C", "source": "S", "_copy": {"name": "P", "source": "elsewhere", "_mod": mod}, "hp": 3}
    grand = {"name": "G", "source": "S", "_copy": {"name": "c", "source": "s", "_mod": {"*": {"mode": "replaceTxt", "replace": "(", "with": "x"}}}}
    orphan = {"name": "O", "source": "S", "_copy": {"name": "none", "source": "S"}, "hp": 1}
    loop = {"name": "L", "source": "S", "_copy": {"name": "L", "source": "S"}}
    d = spark.createDataFrame([("f", json.dumps({"monster": [parent, child, grand, orphan, loop]})), ("bad", "{")], "doc_id string, body string")
    got = {r.name: json.loads(r.body) for r in resolve.inherited(catalogs.read_catalog(d, "creature"), "creature").collect()}
    assert [a["name"] for a in got["C"]["action"]] == ["B2", "C", "D"]
    assert (got["C"]["text"], got["C"]["hp"], got["C"]["name"]) == ("Rex runs", 3, "C")
    assert got["G"]["text"] == "Rex runs"
    assert got["O"] == {"name": "O", "source": "S", "hp": 1}
    assert got["L"] == {"name": "L", "source": "S"}
    assert "_copy" not in got["C"]
    assert "environment" not in got["P"]


def test_resolution(spark):
    wolf = {"name": "Wolf", "source": "MM", "size": ["M"], "type": {"type": "beast"}, "ac": [{"ac": 13}], "hp": {"average": 11}, "str": 12, "cr": "1/4", "trait": [{"name": "Keen"}]}
    light = {"name": "Light", "source": "PHB", "level": 0, "school": "V", "time": [{"number": 1, "unit": "action"}], "range": {"type": "point", "distance": {"type": "touch"}}, "duration": [{"type": "timed", "duration": {"type": "hour", "amount": 1}, "concentration": True}]}
    lamp = {"name": "Lamp", "source": "X", "rarity": "none", "reqAttune": "by a bard", "dmg1": "1d4"}
    d = spark.createDataFrame([("f", json.dumps({"monster": [wolf], "spell": [light], "item": [lamp]}))], "doc_id string, body string")
    refs = spark.createDataFrame([("Wolf|MM", "the wolf", "s1"), ("Wolf|MM", "the wolf", "s2"), ("Ghost|Q", "Ghost", "s1")], "identifier string, display_name string, source_id string")
    got = {r.id: r for r in resolve.resolve(refs, catalogs.read_catalog(d, "creature"), "creature").collect()}
    w = got["wolf"]
    assert (w.label, w.mentions, w.source_file) == ("the wolf", ["s1", "s2"], "MM")
    assert (w.properties.creature_type, w.properties.armor_class, w.properties.hit_points, w.properties.abilities.strength, w.properties.abilities.wisdom, w.properties.traits) == ("beast", 13, 11, 12, 10, ["Keen"])
    assert (got["ghost"].source_file, got["ghost"].properties.size) == ("Q", "Unknown")
    s = resolve.resolve(refs.limit(1).withColumn("identifier", F.lit("light")), catalogs.read_catalog(d, "spell"), "spell").first().properties
    assert (s.casting_time, s.range, s.duration, s.requires_concentration) == ("1 action", "point 0 touch", "1 hour", True)
    i = resolve.resolve(refs.limit(1).withColumn("identifier", F.lit("Lamp|X")), catalogs.read_catalog(d, "item"), "item").first().properties
    assert (i.requires_attunement, i.damage, i.damage_type) == (True, "1d4", "")
    t = spark.createDataFrame([("Wolf", None), ("none", None)], "name string, source string")
    assert {r.name: r.source for r in resolve.vertices(t, catalogs.read_catalog(d, "creature"), "creature").collect()} == {"Wolf": "MM", "none": "unknown"}
    r = resolve.reference_only(spark.createDataFrame([("action", "Dash", "s"), ("background", "Sage", "s")], "entity_type string, display_name string, source_id string"))
    assert keys(r, "id", "type") == [("dash", "Item"), ("sage", "Group")]


def test_canonical(spark):
    u = spark.createDataFrame([("dragons_rest", "Dragon's Rest", ["the temple"], 0), ("runara", "Runara", [], 1)], "id string, label string, aliases array<string>, ord long")
    raw = spark.createDataFrame([("runara", "?"), ("r2", "RUNARA"), ("t", "The Temple"), ("dr", "dragons rests"), ("new", "Nowhere")], "id string, label string")
    assert {r.old_id: (r.new_id, r.tier) for r in canonical.canonical_ids(raw, u).collect()} == {"runara": ("runara", 1), "r2": ("runara", 2), "t": ("dragons_rest", 3), "dr": ("dragons_rest", 4), "new": ("new", None)}
    a = canonical.alias_map(u)
    s = spark.createDataFrame([("s1", "Runara went to the_temple."), ("s2", "nothing"), ("s3", None)], "section_id string, content string")
    assert {r.section_id: r.ids for r in canonical.mentions(s, a).collect()} == {"s1": ["dragons_rest", "runara"]}
    many = spark.createDataFrame([("marsh wolf den gate", "g"), ("cat", "c"), ("", "x"), ("Cat", "c2")], "alias string, id string")
    t = spark.createDataFrame([("t1", "The marsh_wolf den gate."), ("t2", "Two CATS")], "section_id string, content string")
    for size in (containment.TERM_BYTES, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(containment, "TERM_BYTES", size)
            assert {r.section_id: r.ids for r in canonical.mentions(t, many).collect()} == {"t1": ["g"], "t2": ["c", "c2"]}


def test_evaluation(spark):
    x = spark.createDataFrame([("bell",), ("lamp_post",), ("Tower",)], "name string")
    y = spark.createDataFrame([("Bell",), ("Lamp Post",), ("Gate",)], "name string")
    assert keys(evaluate.exact_matches(y, x), "form") == [("bell",)]
    assert keys(evaluate.exact_matches(y, x, underscores=True), "form") == [("bell",), ("lamp post",)]
    assert sorted((m.label, m.extracted, m.method) for m in evaluate.greedy_matches(y, x).collect()) == [("bell", "bell", "exact"), ("lamp post", "lamp_post", "fuzzy")]
    # two labels name the same: the first by name has it, the other gets no second choice
    both = spark.createDataFrame([("lamp posts",), ("lamp pos",), ("Tower",)], "name string")
    more = spark.createDataFrame([("lamp post",), ("lamps",)], "name string")
    assert [(m.label, m.extracted) for m in evaluate.greedy_matches(both, more).collect()] == [("lamp pos", "lamp post")]
    assert keys(evaluate.missing(y, x), "name") == [("Gate",), ("Lamp Post",)]
    r = spark.range(1).select(*evaluate.prf(F.lit(1), F.lit(3), F.lit(3))).first()
    assert [round(v, 1) for v in r] == [33.3, 33.3, 33.3]
    assert list(spark.range(1).select(*evaluate.prf(F.lit(0), F.lit(0), F.lit(0))).first()) == [0, 0, 0]
    assert {r.label: r.bucket for r in evaluate.best_matches(spark.createDataFrame([("bell",)], "name string"), x).collect()} == {"bell": "exact"}


def test_parsers(spark):
    text = "<entities>\nEntity: Dragon's Rest\nType: Location\nAliases: [temple, hall]\nIsGeneric: yes\nEntity:\nID: old_mill\nEntity:\nAliases: x\n</entities>"
    got = parsers.parse_entities(text)
    assert [(e["id"], e["label"], e["type"], e["is_generic"]) for e in got] == [("dragons_rest", "Dragon's Rest", "Location", True), ("old_mill", "Old Mill", "Entity", False)]
    assert got[0]["aliases"] == ["temple", "hall"]
    assert parsers.parse_entities("<summary>none</summary>") == []
    ev = parsers.parse_events("<events>\nEvent: The Fight!\nParticipants: [a, (b)]\nLocation: den\nEvent: Cut")
    assert [(e["id"], e["participants"], e["location"]) for e in ev] == [("the_fight", ["a", "(b)"], "den"), ("cut", [], None)]
    replies = [
        "Is Complete: No\nMissing Locations: B2\n- C5\nIssues:\n- x", "", None, "- stray\nCOMPLETE: Yes\r\n- not one\n  Locations missing\n  -- A 1 \n no item\n- Issue: y\n- B\n", "is complete: yes\nIs complete: no", "issues:\n- a\nIs it complete: true\n- b\nissue\n-c", "complete: TRUE; missing location\n- d",
    ]
    got = spark.createDataFrame(list(enumerate(replies)), "i int, reply string").select("i", parsers.report("reply").alias("r")).select("i", "r.*")
    assert keys(got, "i", "is_complete", "missing_locations", "issues") == [
        (0, False, ["C5"], ["x"]), (1, False, [], []), (2, False, [], []), (3, True, ["A 1"], ["B"]), (4, False, [], []), (5, True, [], ["a", "c"]), (6, True, [], []),
    ]
    assert "Python" not in got._jdf.queryExecution().toString()
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("v")).first().v
    rel = one(parsers.relations, "Source: a\nTarget: b\nRelation: r\nDescription: d\n\nSource: a\nRelation: r\n\nSource: c\nSource: d\nTarget: e\nRelation: q")
    assert [tuple(r) for r in rel] == [("a", "b", "r", "d"), ("d", "e", "q", "")]
    assert one(parsers.resolution_map, "# x\na -> b\nc: d\ne -> e\na -> z") == {"a": "z", "c": "d"}
    assert one(parsers.location_ids, '{"location_id": "x"}') == ["x"]
    assert one(parsers.location_ids, '{"location_ids": ["x", "y"]}') == ["x", "y"]
    assert one(parsers.location_ids, "nope") == []


def test_sql_functions(spark):
    from tomegraph.functions.register import register

    register(spark)
    r = spark.sql("SELECT snake_id(\"Marsh-Wolf's Den (2)\") a, md5_id('monster', 'Marsh Wolf', 'ABC') b, similar_labels('cliff_top', 'clifftop') c, weighted_ratio('a', 'a') d, size(parse_entities('Entity: X')) e, normalized_label('A_b  c') f").first()
    assert tuple(r) == ("marsh_wolfs_den_2", "ed296235fd0771a7e6e7b2ef365be508", True, 100.0, 1, "a b c")


def test_streams(spark, tmp_path):
    from tomegraph.streaming import incremental

    for i, rows in enumerate(([("a", "x", "t", 0)], [("a", "xyz", "t", 0), ("b", "b", "t", 1)])):
        spark.createDataFrame(rows, N).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(N).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = incremental.merge_nodes(s, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    versions = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert {r.id: r.label for r in spark.read.parquet(str(versions[-1])).collect()} == {"a": "xyz", "b": "b"}


def test_more_operators(spark):
    n = nodes(spark, ("c", "Cat", "Creature", 0), ("l", "Den", "Location", 1))
    e = edges(spark, ("l", "c", "houses"))
    assert keys(paths.pattern(n, e, "Creature", "Location"), "first", "second", "forward") == [("c", "l", False)]
    assert keys(graph.within_chars(n, "label", 4), "id") == [("c",)]
    assert [r.label for r in hetero.suggestions(n).collect()] == ["Cat", "Den"]
    x = evaluate.extras(spark.createDataFrame([("Den",)], "name string"), n.select(F.col("label").alias("name"), "type"))
    assert keys(x, "type", "name", "n") == [("Creature", "Cat", 1)]
    got = parsers.parse_unified("<entities>\nEntity: A\n</entities>\n<events>\nEvent: B")
    assert ([v["label"] for v in got["entities"]], [v["label"] for v in got["events"]]) == (["A"], ["B"])
    emb = search.embedded(n, "label", search.HashingEmbedder(64))
    assert "Den --[houses]--> Cat" in context.answer_query(emb, e, "Den", search.HashingEmbedder(64), top_k=1)["context"]


def test_resolve_all(spark):
    d = spark.createDataFrame([("f", json.dumps({"monster": [{"name": "Wolf", "source": "MM", "type": "beast"}], "spell": []}))], "doc_id string, body string")
    refs = spark.createDataFrame([("creature", "Wolf|MM", "Wolf", "s"), ("creature", "Ghost|Q", "Ghost", "s"), ("spell", "Fog", "Fog", "s"), ("action", "Dash", "Dash", "s")], "entity_type string, identifier string, display_name string, source_id string")
    got = resolve.resolve_all(refs, {k: catalogs.read_catalog(d, k) for k in ("creature", "spell")})
    rows = {r.id: r for r in got.collect()}
    assert json.loads(rows["ghost"].properties)["armor_class"] == 10
    assert json.loads(rows["fog"].properties)["duration"] == "Unknown"
    assert (rows["dash"].type, rows["dash"].source_file) == ("Item", "Adventure")
    assert keys(resolve.seeds(got), "id", "creature_type", "location_type")[-1] == ("wolf", "beast", None)
    assert {(r.entity_type, r.n, r.n_matched) for r in stats.resolution_stats(got).collect()} >= {(None, 4, 1), ("creature", 2, 1)}


def test_similar_pairs(spark):
    """Without a common prefix, against all pairs."""
    r = random.Random(3)
    labels = {"", "a", "ab", "abc", "cold anvil", "old anvil", "Ünder the hill", "the hill", "𝄞 clef", "clef"}
    labels |= {"".join(r.choice("abc ") for _ in range(r.choice((1, 2, 3, 5, 6, 9, 12, 15)))) for _ in range(90)}
    labels |= {"".join(r.choice("xyz") if r.random() < 0.1 else c for c in r.choice("xyz") + base) for base in ("the old tower by the river", "a marsh of many names") for _ in range(15)}
    df = spark.createDataFrame([(x,) for x in sorted(labels)], "label string")
    a, b = df.select(F.col("label").alias("a")), df.select(F.col("label").alias("b"))
    want = {tuple(x) for x in a.join(b, F.col("a") < F.col("b")).where(S.similar_labels(F.col("a"), F.col("b"))).collect()}
    got = [tuple(x) for x in canonical.similar_pairs(df).collect()]
    assert set(got) == want
    assert len(got) == len(want) > 100
    assert ("cold anvil", "old anvil") in want


def test_similar_labels_all_finds_pairs(spark, sf):
    assert ("cold anvil", "old anvil", 1) in {tuple(x) for x in queries.QUERIES["similar_labels"](spark, sf).collect()}


def test_canonical_ids_by_own_alias_and_near_blocks(spark):
    u = spark.createDataFrame([("door", "Door", [], 1), ("orc", "Orc", [], 2), ("mill", "Old Mill", [], 3), ("inn", "Inn", ["tavern"], 4), ("orca", "Orca", [], 5)], "id string, label string, aliases array<string>, ord long")
    raw = spark.createDataFrame([("d", "Doors", []), ("o", "Orcs", None), ("w", "Windwheel", ["the wheel", "Old Mill"]), ("t", "Tavern", ["old mill"]), ("x", "Lantern", ["lamp"])], "id string, label string, aliases array<string>")
    assert {r.old_id: (r.new_id, r.tier) for r in canonical.canonical_ids(raw, u).collect()} == {"d": ("door", 4), "o": ("orc", 4), "w": ("mill", 5), "t": ("mill", 5), "x": ("x", None)}
