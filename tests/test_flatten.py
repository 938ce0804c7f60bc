"""Both profiles against the plain walk on random documents."""

import json
import random

import pytest
from tests import plain_walk
from tomegraph.operators import flatten

KINDS = ["section", "entries", "inset", "list", "table", "image", "gallery", "quote", "mystery", None]


def entry(r, depth):
    text = lambda: r.choice(["", "a", "{@creature Wolf|MM}", 'x "y", z: \\', "é☃", "two words"])
    kind = r.choice(KINDS)
    if kind is None or depth > 5:
        return r.choice([text(), 7, None, True, ["in", "list"], {"entries": ["bare"]}, {}])
    e = {"type": kind}
    if r.random() < 0.6:
        e["id"] = r.choice(["", f"id{r.randrange(9)}", 12, 0])
    if r.random() < 0.7:
        e["name"] = r.choice(["", "Name", "Ünï", 5])
    if r.random() < 0.4:
        e["page"] = r.choice([3, "x", None, 2.5])
    if kind in ("section", "entries", "inset", "quote", "mystery") and r.random() < 0.85:
        e["entries"] = [entry(r, depth + 1) for _ in range(r.randrange(5))]
    if kind == "list":
        e["items"] = [r.choice([text(), 4, {"name": "N", "entry": text()}, {"entry": text()}, {"name": "", "entry": 3}, {"name": "lost", "entries": ["x"]}]) for _ in range(r.randrange(4))]
    if kind == "table":
        e["caption"] = r.choice(["", "Cap {@item Rope}", 3])
        e["rows"] = [r.choice([[text(), 2, True, None, {"b": 'q"', "c": [1, "x,y:z"]}], text(), [], 1.5]) for _ in range(r.randrange(4))]
    if kind == "image":
        e["title"] = r.choice(["", "Map", 4])
        if r.random() < 0.5:
            e["imageType"] = r.choice(["", "map"])
    if kind == "gallery":
        e["images"] = [r.choice([{"title": "View"}, {"title": ""}, "no", {"title": "Q", "imageType": "art"}]) for _ in range(r.randrange(3))]
    return e


def bodies():
    r = random.Random(7)
    out = []
    for i in range(120):
        entries = [entry(r, 0) for _ in range(r.randrange(6))]
        out.append(json.dumps({"data": entries} if i % 3 else entries, ensure_ascii=False))
    deep = ["bottom"]
    for k in range(9):
        deep = [{"type": "section", "id": f"d{k}", "entries": deep}, f"after {k}"]
    return out + [json.dumps(deep), "{broken", None, "", "3", "null", '{"data": {"type": "section"}}', "[]"]


@pytest.mark.parametrize("profile", ["shadow", "indexed"])
def test_equals_the_plain_walk(spark, profile):
    rows = [(f"doc{i % 100}", b) for i, b in enumerate(bodies())]  # some ids twice
    got = flatten.raw_nodes(spark.createDataFrame(rows, "doc_id string, body string"), profile)
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    fields = ("path", "parent_path", "depth", "node_id", "title", "type", "page", "ignored")
    flat = lambda d, n: repr((d, *(n[f] for f in fields), [(x["prefix"], x["text"], x["tagged"]) for x in n["lines"]]))
    want = sorted(flat(d, n) for d, b in rows for n in plain_walk.walk(b, profile))
    assert sorted(flat(x.doc_id, x) for x in got.collect()) == want
    assert len(want) > 100


def test_types_anywhere(spark):
    odd = [json.dumps({"a": 'x,"type":"no"', "b": [{"type": 'q"uote\\ é'}, {"x": {"type": "deep"}}, {"type": 3}], "type": "top", "c": ["x,", "type", ":"]}, ensure_ascii=False)]
    rows = [(str(i), b) for i, b in enumerate(bodies() + odd)]
    want = set()
    for _, b in rows:
        try:
            want |= set(plain_walk.types(json.loads(b or "")))
        except ValueError:
            pass
    got = [x.type for x in flatten.entry_types(spark.createDataFrame(rows, "doc_id string, body string")).collect()]
    assert got == sorted(want)
