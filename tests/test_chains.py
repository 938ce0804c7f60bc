import json
import random

from pyspark.sql import functions as F
from tomegraph.operators import chains, graph, resolve
from tomegraph.sources import catalogs


def links(spark, pairs):
    return spark.createDataFrame(pairs, "id string, parent string")


def followed(pairs):
    """Plain walk: id -> (root, distance, cyclic)."""
    parent = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[a] = min(b, parent.get(a, b))
    out = {}
    for a in parent:
        seen, at = [a], parent[a]
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        out[a] = (min(seen[seen.index(at) :]), None, True) if at in seen else (at, len(seen), False)
    return out


def test_random_links(spark):
    for seed in range(4):
        r = random.Random(seed)
        pairs = [(f"n{i:03}", f"n{r.randrange(60):03}" if seed % 2 else f"n{max(0, i - 1 - r.randrange(2)):03}") for i in range(60)] + [("n003", None), (None, "n001"), ("x", "y"), ("x", "n000")]
        got = {x.id: (x.root, x.distance, x.cyclic) for x in chains.ends(links(spark, pairs)).collect()}
        assert got == followed(pairs)
    assert chains.ends(links(spark, [])).count() == 0


def test_a_chain_is_followed_to_its_end(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    got = {r.old_id: r.new_id for r in graph.transitive(spark.createDataFrame(pairs, "old_id string, new_id string")).collect()}
    assert set(got.values()) == {"n100"} and len(got) == 100
    ring = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")]
    got = {r.old_id: r.new_id for r in graph.transitive(spark.createDataFrame(ring, "old_id string, new_id string")).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "d"}


def test_lineage(spark):
    pairs = [(f"n{i:02}", f"n{i - 1:02}") for i in range(1, 25)] + [("a", "b"), ("b", "a")]
    for depth in (1, 3, 10, 16, 40):
        got = {r.id: r.ancestors for r in chains.lineage(links(spark, pairs), depth).collect()}
        for i in range(1, 25):
            assert got[f"n{i:02}"] == [f"n{j:02}" for j in range(i - 1, max(-1, i - 1 - depth), -1)]
        assert got["a"] == (["b", "a"] * depth)[:depth]


def records(spark, rows):
    body = [json.dumps({"monster": [{"name": n, "source": s, **extra} for n, s, extra in rows]})]
    return catalogs.read_catalog(spark.createDataFrame([("d", b) for b in body], "doc_id string, body string"), "creature")


def test_inheritance_beyond_and_in_cycles(spark):
    rows = [("n0", "S", {"hp": 1, "tags": ["t0"]})]
    rows += [(f"n{i}", "S", {"_copy": {"name": f"N{i - 1}", "source": "s", "_mod": {"tags": {"mode": "appendArr", "items": f"t{i}"}}}}) for i in range(1, 14)]
    rows += [("a", "S", {"x": 1, "_copy": {"name": "b"}}), ("b", "S", {"y": 2, "_copy": {"name": "c", "source": "S"}}), ("c", "S", {"_copy": {"name": "a", "source": "none"}}), ("own", "S", {"_copy": {"name": "own"}}), ("alone", "S", {"_copy": {"name": "missing"}})]
    got = {r.name: json.loads(r.body) for r in resolve.inherited(records(spark, rows), "creature").collect()}
    assert got["n10"]["hp"] == 1 and "hp" not in got["n11"]
    assert got["n10"]["tags"] == [f"t{i}" for i in range(11)]
    assert got["a"]["y"] == 2 and got["c"]["x"] == 1 and got["alone"] == {"name": "alone", "source": "S"}
    deep = {r.name: json.loads(r.body) for r in resolve.inherited(records(spark, rows), "creature", depth=20).collect()}
    assert deep["n13"]["tags"] == [f"t{i}" for i in range(14)]
    rings = {(r.name, r.cycle_name) for r in resolve.copy_cycles(records(spark, rows)).collect()}
    assert rings == {("a", "a"), ("b", "a"), ("c", "a"), ("own", "own")}


def test_patches():
    items = [{"name": "A"}, "B", {"x": 1}, {"name": "A"}]
    assert resolve.edited(items, {"mode": "removeArr", "names": "A"}) == ["B", {"x": 1}]
    assert resolve.edited(items, {"mode": "removeArr", "names": ["A", "B"]}) == [{"x": 1}]
    assert resolve.edited(items, {"mode": "removeArr"}) == items
    assert resolve.edited(items, {"mode": "replaceArr", "replace": "A", "items": 7}) == [7, "B", {"x": 1}, {"name": "A"}]
    assert resolve.edited(items, {"mode": "replaceArr", "replace": "Z", "items": 7}) == items
    assert resolve.edited(["a"], {"mode": "appendArr", "items": ["b", "c"]}) == ["a", "b", "c"]
    assert resolve.edited(["a"], {"mode": "appendArr", "items": {"n": 1}}) == ["a", {"n": 1}]
    assert resolve.edited(items, {"mode": "other"}) == resolve.edited(items, "no") == items
    out = resolve.merge_chain([{"x": "k"}, {"_copy": {"_mod": {"*": {"mode": "replaceTxt", "replace": "(", "with": ""}}}, "t": ["a(b", {"k(": "c("}]}], ())
    assert out == {"t": ["a(b", {"k(": "c("}], "x": "k"}
    out = resolve.merge_chain([{"_copy": {"_mod": {"*": {"mode": "replaceTxt", "replace": "WOLF", "with": "Rex", "flags": "i"}}}}, {"t": ["wolf", {"wolf": "a Wolf"}], "n": 3}], ())
    assert out == {"t": ["Rex", {"wolf": "a Rex"}], "n": 3}
