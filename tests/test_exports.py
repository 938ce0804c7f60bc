import json
import random

import pytest
from tomegraph.operators import metrics
from tomegraph.sources import sinks


def whole(spark, path, tmp_path):
    target = str(tmp_path / "whole.json")
    size = sinks.join_document(spark, path, target)
    body = (tmp_path / "whole.json").read_bytes()
    assert len(body) == size
    return json.loads(body)


def test_a_graph_in_many_parts_is_one_document(spark, tmp_path):
    n = spark.range(5000).selectExpr("concat('n', id) AS id", "concat('line\\nbreak \"', id, '\" \\\\ é') AS label", "id * 7 % 5000 AS ord").repartition(6)
    e = n.selectExpr("id AS source", "'n0' AS target", "ord")
    path = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows make one part
    try:
        parts = sinks.write_graph(n, e, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for p in parts if p["bytes"]]) > 2
    got = whole(spark, path, tmp_path)
    want = sorted(n.collect(), key=lambda r: r.ord)
    assert got["nodes"] == [{"id": r.id, "label": r.label} for r in want]
    assert [x["source"] for x in got["edges"]] == [r.id for r in want]
    sinks.write_graph(n.limit(0), e.limit(0), path)
    assert whole(spark, path, tmp_path) == {"nodes": [], "edges": []}


def test_section_map_of_one_hot_section(spark, tmp_path):
    rows = [("hot", f"l{i}", i) for i in range(300)] + [(f's"{i % 40}', "x\ny", i) for i in range(80)] + [("dup", "a", 1), ("dup", "a", 1), (None, "lost", 0)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "m")
    sinks.write_section_map(spark.createDataFrame(rows, "section_id string, location_id string, ord long").repartition(5), path)
    got = whole(spark, path, tmp_path)
    assert got["hot"] == [f"l{i}" for i in range(300)] and got["dup"] == ["a", "a"]
    assert got['s"3'] == ["x\ny"] * 2 and len(got) == 42
    sinks.write_section_map(spark.createDataFrame([], "section_id string, location_id string, ord long"), path)
    assert whole(spark, path, tmp_path) == {}


def test_vertices_and_damaged_parts(spark, tmp_path):
    v = spark.range(100).selectExpr("concat('v', id) AS id", "if(id % 3 = 0, 'Item', 'Spell') AS label", "'n' AS name", "cast(null AS string) AS source", "'{}' AS attributes")
    path = str(tmp_path / "v")
    parts = sinks.write_vertices(v, 'a "b"', "f.json", path)
    got = whole(spark, path, tmp_path)
    assert got["meta"] == {"stats": {"Item": 34, "Spell": 66}, "description": 'a "b"', "source_file": "f.json"}
    assert sorted(x["id"] for x in got["nodes"]) == sorted(f"v{i}" for i in range(100))
    with open(f"{path}/{parts[0]['name']}", "a") as f:
        f.write("more")
    crc = tmp_path / "v" / f".{parts[0]['name']}.crc"
    crc.unlink(missing_ok=True)
    with pytest.raises(ValueError):
        sinks.join_document(spark, path, str(tmp_path / "other.json"))


def test_components_by_batches_equal_a_full_run(spark):
    r = random.Random(5)
    edges = lambda pairs: spark.createDataFrame(pairs, "source string, target string")
    nodes = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    labels = metrics.components(nodes([]), edges([]))
    ids, pairs = [], []
    for n in range(4):
        more = [f"n{r.randrange(120):03}" for _ in range(30)] + ([None] if n == 1 else [])
        ids += [i for i in more if i]
        new = [(r.choice(ids), r.choice(ids)) for _ in range(14)] + [("ghost", ids[0]), (ids[0], None), (ids[1], ids[1])]
        pairs += new
        labels = metrics.materialise(metrics.grown_components(labels, nodes(more), edges(new)), "grown")
        got = sorted(tuple(x) for x in labels.collect())
        assert got == sorted(tuple(x) for x in metrics.components(nodes(set(ids)), edges(pairs)).collect())
    again = metrics.grown_components(labels, nodes(ids), edges(new))
    assert sorted(tuple(x) for x in again.collect()) == got
