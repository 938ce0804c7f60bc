import json

import pytest

from tomegraph.operators import flatten, traverse
from tomegraph.plans import stages
from tomegraph.plans.client import ReplayClient, RuleClient, call, prompt_hash, truncations
from tomegraph.plans.pipeline import Build

BOOK = {"data": ["loose", {"type": "section", "id": "s1", "name": "Harbour", "entries": [
    "Boats of {@creature Marsh Wolf|ABC}.", {"type": "entries", "name": "Pier", "entries": ["Planks."]},
    {"type": "list", "items": ["rope", {"name": "Bell", "entry": "rings"}, {"entry": "bare"}, {"name": "lost", "entries": ["x"]}]},
    {"type": "table", "caption": "Tides", "rows": [["high", 2], ["low", 1]]}, {"type": "image", "title": "Map", "imageType": "map"}, {"type": "image"},
    {"type": "gallery", "images": [{"title": ""}, {"title": "View"}]}, {"type": "quote", "entries": ["Beware", {"type": "x"}]}, {"type": "mystery", "entries": ["dropped"]}, "End."]}]}
LINES = ["Boats of Marsh Wolf.", "- rope", "- **Bell**: rings", "- bare", "**Table: Tides**", "high | 2", "low | 1", "[Image (map): Map]", "**Gallery:**", "[Image: View]", "> Beware", "End."]


def docs(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "doc_id string, body string")


def test_shadow_profile(spark):
    got = {r.title: r for r in flatten.flatten(docs(spark, BOOK)).collect()}
    assert set(got) == {"Harbour", "Pier"}
    assert got["Harbour"].content.split("\n") == LINES
    assert got["Harbour"].ignored == 1
    assert [(x.text, x.tag, x.attrs) for x in got["Harbour"].links] == [("Marsh Wolf", "creature", ["ABC"])]
    assert (got["Pier"].node_id, got["Pier"].content, got["Pier"].depth) == ("", "Planks.", 1)


def test_indexed_profile(spark):
    nodes = flatten.flatten(docs(spark, BOOK), "indexed")
    got = nodes.collect()
    assert len(got) == 1
    lines = got[0].content.split("\n")
    assert lines[1] == "Planks."
    assert "dropped" in lines
    refs = flatten.external_refs(nodes).collect()
    assert [(r.entity_type, r.identifier, r.source_id, r.display_name) for r in refs] == [("creature", "Marsh Wolf|ABC", "s1", "Marsh Wolf")]


def test_odd_documents(spark):
    nodes = flatten.flatten(docs(spark, "not json", None, "[]", "{}", '{"data": 3}', [{"type": "section"}]))
    assert [(r.title, r.content) for r in nodes.collect()] == [("Untitled Section", "")]
    assert [r.type for r in flatten.entry_types(docs(spark, BOOK, "x")).collect()] == sorted({"section", "entries", "list", "table", "image", "gallery", "quote", "x", "mystery"})


def tree(spark):
    body = [{"type": "section", "id": "a", "name": "A", "entries": [{"type": "entries", "id": "b", "name": "B", "entries": [{"type": "entries", "id": "c", "name": "C", "entries": ["deep"]}]}, {"type": "entries", "id": "d", "name": "D", "entries": ["side {@item Lamp}"]}]}, {"type": "section", "id": "e", "name": "E"}]
    return flatten.flatten(docs(spark, body))


def test_traversal(spark):
    nodes = tree(spark)
    assert [r.node_id for r in traverse.preorder(nodes).collect()] == ["a", "b", "c", "d", "e"]
    assert [r.node_id for r in traverse.postorder(nodes).collect()] == ["c", "b", "d", "a", "e"]
    assert {(r.node_id, r.parent_title) for r in traverse.with_family(nodes).collect()} == {("c", "B"), ("d", "A")}
    assert [r.node_id for r in traverse.subtree(nodes, "d0", [0], 1).collect()] == ["a", "b", "d"]
    assert [r.node_id for r in traverse.mentions(nodes, "lamp").collect()] == ["d"]
    assert [r.node_id for r in traverse.roots(nodes).collect()] == ["a", "e"]
    assert {r.breadcrumb for r in traverse.breadcrumbs(nodes).collect()} >= {"A > B > C", "E"}
    assert traverse.by_id(nodes, "c").first().content == "deep"
    assert traverse.cards(nodes).count() == 5


def test_roll_up_and_accumulate(spark):
    nodes = tree(spark)
    got = {tuple(r.path): r.summary for r in traverse.roll_up(nodes).collect()}
    assert got[(0,)] == "[A]: [B]: [C]: deep\n[D]: side Lamp"
    assert got[(1,)] is None
    rows = spark.createDataFrame([("d0", [0, 0], "x", "own", 0), ("d0", [0], "x", "top", 0), ("d0", [0, 1], "y", "y", 0)], "doc_id string, path array<int>, id string, label string, ord int")
    acc = {(tuple(r.at), r.id): r.label for r in traverse.accumulated(rows).collect()}
    assert acc == {((0,), "x"): "top", ((0,), "y"): "y", ((0, 0), "x"): "own", ((0, 1), "y"): "y"}


def test_calls_are_recorded(spark):
    prompts = spark.createDataFrame([("k1", "hello"), ("k2", "unknown")], "key string, prompt string")
    got = {r.key: r for r in call(prompts, ReplayClient({prompt_hash("hello", "s"): "hi"}), "s").collect()}
    assert (got["k1"].response, got["k1"].status) == ("hi", "ok")
    assert got["k2"].status == "error"
    assert truncations(spark.createDataFrame([("s", "k", "p", "r", "length")], "stage string, key string, prompt string, response string, finish_reason string")).count() == 1


def test_build(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps(BOOK))
    b = Build(spark, f"file://{tmp_path}/book.json", f"file://{tmp_path}/out", RuleClient())
    assert b.run(["all"], dry_run=True) == ["shadow", "spatial", "mapping", "entity"]
    b.run()
    assert b._read("location_nodes").count() > 0
    assert b._read("entity_nodes").count() > 0
    b.run(["shadow"])
    import pytest

    with pytest.raises(FileNotFoundError):
        Build(spark, f"file://{tmp_path}/book.json", f"file://{tmp_path}/none", RuleClient()).run(["mapping"])
    with pytest.raises(ValueError, match="no such stage"):
        b.run(["nope"])


def test_in_order(spark):
    out = stages.extract_in_order(tree(spark), RuleClient())
    assert out.count() == 5


class Teller:
    """One creature a section, named alike but with a label of the section's own; some calls fail, one is cut short."""

    def complete(self, prompt, params):
        body = prompt.rpartition("### TEXT\n")[2]
        if "fails" in body:
            raise TimeoutError("no answer")
        return f"<entities>\nEntity: {body.strip()}\nID: same\nType: Creature\n</entities>", "length" if "long" in body else "stop"


def test_document_order_and_failed_calls(spark):
    """Sections 9 and 10 of two documents: neither hashes nor texts of paths give this order."""
    entries = [{"type": "section", "id": f"s{i}", "entries": [f"Told {chr(65 + i)}" + (" fails" if i == 5 else " long" if i == 6 else "")]} for i in range(12)]
    out = stages.semantic(docs(spark, entries, entries[3:]), {}, Teller())
    assert [(r.id, r.label) for r in out["nodes"].collect()] == [("same", "Told G long")]  # the longest label wins, the first of those
    calls = {r.key: (r.status, r.error, r.finish_reason) for r in out["calls"].collect()}
    assert len(calls) == 21 and calls["d0/5"] == calls["d1/2"] == ("error", "TimeoutError: no answer", None)
    assert sorted(r.key for r in truncations(out["calls"]).collect()) == ["d0/6", "d1/3"]
    extracted = stages.extract_in_order(flatten.flatten(docs(spark, entries, entries[3:]), "indexed"), Teller())
    told = extracted.selectExpr("doc_id", "path", "posexplode(entities) AS (i, e)").selectExpr("doc_id", "path", "i", "e.label")
    rows = stages.in_document_order(told, "i").orderBy("ord").collect()
    assert [r.label[5] for r in rows] == list("ABCDEGHIJKL") + list("DEGHIJKL")
    assert [r.ord for r in rows] == list(range(1, 20))
    from pyspark.sql import functions as F

    assert [r.label for r in rows] != [r.label for r in sorted(told.withColumn("h", F.xxhash64("doc_id", "path", "i")).collect(), key=lambda r: r.h)]


def test_calls_in_flight(monkeypatch):
    from tomegraph.plans import client

    assert (client.concurrency("qwen-7b"), client.concurrency("other")) == (5, 50)
    monkeypatch.setenv("LLM_CONCURRENCY", "3")
    assert client.concurrency("other") == 3


class Scripted:
    """Fixed replies by stage."""

    def __init__(self, **replies):
        self.replies = replies

    def complete(self, prompt, params):
        return self.replies.get(params["stage"], ""), "stop"


def test_sub_locations_and_their_report(spark):
    """A further spatial pass brings only places that aren't known, each edge once; the report tells what is missing."""
    place, edge = (lambda i: {"id": i, "label": i.title(), "type": "location"}), {"source": "mill", "target": "loft", "relation": "contains"}
    client = Scripted(graph=json.dumps({"nodes": [place("mill"), place("loft")], "edges": [edge, edge]}), verify="Is complete: no\nMissing locations:\n- Cellar\nIssues:\n- a loop")
    parents = spark.createDataFrame([("mill", "The mill has a loft.", 1)], "key string, text string, ord long")
    n, e = stages.sub_locations(parents, client, spark.createDataFrame([("mill",)], "id string"))
    assert [(r.id, r.label) for r in n.collect()] == [("loft", "Loft")]
    assert [(r.source, r.relation, r.target) for r in e.collect()] == [("mill", "contains", "loft")]
    r = stages.verify(parents, client).first()
    assert (r.key, r.is_complete, r.missing_locations, r.issues) == ("mill", False, ["Cellar"], ["a loop"])


def test_two_phase(spark):
    client = Scripted(ner="<entities>\nEntity: Old Mill\nType: Location\nEntity: Ann\nType: Creature\n</entities>", relations="Source: ann\nRelation: lives_in\nTarget: old_mill\nDescription: d")
    sections = spark.createDataFrame([("s1", "Ann went to the Old Mill and stayed there for the long cold winter."), ("s2", "short")], "section_id string, content string")
    n, e = stages.two_phase(sections, client)
    assert {r.id for r in n.collect()} == {"ann", "old_mill"}
    assert [(r.source, r.relation, r.target) for r in e.collect()] == [("ann", "lives_in", "old_mill")]


def test_semantic(spark):
    client = Scripted(events="<entities>\nEntity: Harbour\nType: Location\nID: harbour\n</entities>\n<events>\nEvent: Storm\nType: encounter\nLocation: harbour\nParticipants: marsh_wolf\n</events>")
    from tomegraph.sources.catalogs import read_catalog

    catalog = read_catalog(docs(spark, {"monster": [{"name": "Marsh Wolf", "source": "ABC"}]}), "creature")
    out = stages.semantic(docs(spark, BOOK), {"creature": catalog}, client)
    assert {r.id: r.node_type for r in out["nodes"].collect()} == {"marsh_wolf": "entity", "harbour": "entity", "storm": "event"}
    assert {(r.source, r.relation, r.target) for r in out["edges"].collect()} == {("storm", "occurs_at", "harbour"), ("storm", "has_participant", "marsh_wolf")}
    assert out["stats"].count() > 0


class Recorder(Scripted):
    """Keeps the prompts in a file, for calls run in other processes."""

    def __init__(self, path, **replies):
        super().__init__(**replies)
        self.path = path

    def complete(self, prompt, params):
        with open(self.path, "a") as f:
            f.write(f"<{params['stage']}>{prompt}\n")
        return super().complete(prompt, params)


def test_semantic_relations(spark, tmp_path):
    """Seeds are known, and edges of the hierarchy and of relations come out beside the events'."""
    from tomegraph.sources.catalogs import read_catalog

    text = {"data": [{"type": "section", "name": "One", "id": "001", "entries": ["The Harbour has a Quay, where the {@creature Marsh Wolf|ABC} sleeps."]}]}
    client = Recorder(
        str(tmp_path / "prompts"),
        events="<entities>\nEntity: Harbour\nType: Location\nID: harbour\n\nEntity: Quay\nType: Location\nID: quay\n</entities>",
        hierarchy="Relation: part_of\nSource: quay\nTarget: harbour\nDescription: d",
        relations="Relation: inhabits\nSource: marsh_wolf\nTarget: quay\nDescription: d",
    )
    catalog = read_catalog(docs(spark, {"monster": [{"name": "Marsh Wolf", "source": "ABC"}]}), "creature")
    out = stages.semantic(docs(spark, text), {"creature": catalog}, client)
    assert {(r.source, r.relation, r.target) for r in out["edges"].collect()} == {("quay", "part_of", "harbour"), ("marsh_wolf", "inhabits", "quay")}
    asked = (tmp_path / "prompts").read_text()
    assert "[marsh_wolf] Marsh Wolf" in asked.partition("<events>")[2]
    assert "List the events" in asked.partition("<events>")[2]


def test_the_summarised_table_comes_first(spark, tmp_path):
    from tomegraph.sources import documents

    plain, summarised = f"{tmp_path}/tree", f"{tmp_path}/tree_summary"
    spark.range(3).write.parquet(plain)
    assert documents.read_first(spark, summarised, plain).count() == 3
    spark.range(5).write.parquet(summarised)
    assert documents.read_first(spark, summarised, plain).count() == 5
    with pytest.raises(FileNotFoundError):
        documents.read_first(spark, f"{tmp_path}/none")


def test_trees(spark):
    docs = spark.createDataFrame([("a", json.dumps(BOOK)), ("none", "{")], "doc_id string, body string")
    nodes = flatten.flatten(docs)
    got = {r.doc_id: json.loads(r.body) for r in traverse.trees(nodes).collect()}
    assert [(x["title"], [(y["title"], y["content"], y["children"]) for y in x["children"]]) for x in got["a"]] == [("Harbour", [("Pier", "Planks.", [])])]
    assert set(got) == {"a"}
    assert traverse.trees(nodes.where("doc_id = 'none'")).count() == 0
    orphan = {r.doc_id: json.loads(r.body) for r in traverse.trees(nodes.where("depth = 1")).collect()}
    assert [x["title"] for x in orphan["a"]] == ["Pier"]


def test_roll_up_in_one_pass(spark):
    """Equal to the way level by level on random trees, in as many jobs for a long chain as for a short one."""
    import random

    r = random.Random(8)
    rows = []
    for d in range(6):
        places = [[0], [1]]
        for _ in range(40):
            up = r.choice(places)
            places.append([*up, sum(p[:-1] == up for p in places)])
        rows += [(f"d{d}", p, p[:-1], len(p) - 1, f"T{i}", r.choice(["", " ", "text", "two\nlines", traverse.NO_SPATIAL_INFO])) for i, p in enumerate(places)]
    schema = "doc_id string, path array<int>, parent_path array<int>, depth int, title string, content string"
    nodes = spark.createDataFrame(rows, schema)
    key = lambda df: sorted((x.doc_id, x.path, x.summary or "-") for x in df.collect())
    assert key(traverse.roll_up(nodes)) == key(traverse.roll_up(nodes, traverse.own_and_below))
    orphans = nodes.where("depth <> 1")
    assert key(traverse.roll_up(orphans)) == key(traverse.roll_up(orphans, traverse.own_and_below))

    def jobs(n):
        chain = spark.createDataFrame([("c", [0] * i, [0] * (i - 1), i - 1, f"{i}", "end" if i == n else "") for i in range(1, n + 1)], schema)
        spark.sparkContext.setJobGroup(f"chain-{n}", "roll-up")
        top = [x.summary for x in traverse.roll_up(chain).collect() if len(x.path) == 1]
        assert top == ["".join(f"[{i}]: " for i in range(1, n + 1)) + "end"]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))

    assert jobs(700) == jobs(5) < 15
