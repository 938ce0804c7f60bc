import random

import pytest
from pyspark.sql import functions as F
from tomegraph.sources import keyed
from tomegraph.sources.keyed import Conflict, KeyedTable

KIND = "a string, b long, text string, ord long"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def contents(table, version=None):
    return {(r.a, r.b): r.text for r in table.read(version).collect()}


def test_batches_equal_a_dict_and_leave_other_files_alone(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], rows_per_file=40)
    with pytest.raises(FileNotFoundError):
        t.read()
    r = random.Random(1)
    want = {(f"k{i:03}", i % 3): f"v{i}" for i in range(300)}
    t.upsert(frame(spark, [(a, b, x, 0) for (a, b), x in want.items()]))
    assert contents(t) == want and len(t.manifest()["files"]) >= 6
    for n in range(3):
        before = {f[1] for f in t.manifest()["files"]}
        low = r.randrange(250)
        rows = [(f"k{low + i % 9:03}", r.randrange(4), f"n{n}.{i}", i) for i in range(30)] + [(None, n % 2, "null key", 1), (None, n % 2, "older", 0)]
        t.upsert(frame(spark, rows), "ord")
        want.update({(a, b): x for a, b, x, _ in rows[:30]})
        want[None, n % 2] = "null key"
        assert contents(t) == want
        after = {f[1]: f for f in t.manifest()["files"]}
        assert len(before & set(after)) >= len(before) - 4
        assert sum(f[2] for f in after.values()) == len(want)
    asked = frame(spark, [("k100", 1, "", 0), ("none", 0, "", 0), (None, 0, "", 0)])
    assert {(x.a, x.b) for x in t.lookup(asked).collect()} == {("k100", 1), (None, 0)}
    kept = t.version()
    t.delete(frame(spark, [(None, 0, "", 0), ("k100", 1, "", 0), ("none", 9, "", 0)]))
    assert contents(t) == {k: v for k, v in want.items() if k not in {(None, 0), ("k100", 1)}}
    assert contents(t, kept) == want
    assert t.vacuum() > 0 and len(contents(t)) == len(want) - 2


def test_replay_empty_batches_and_growth(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["a"], rows_per_file=20)
    t.upsert(frame(spark, [("x", 1, "one", 0), ("x", 2, "two", 0)]), batch=("s", 0))
    assert [(r.b, r.text) for r in t.read().collect()] == [(2, "two")]
    before = t.manifest()
    assert t.upsert(frame(spark, [("x", 1, "other", 9)]), batch=("s", 0)) == before["version"]
    assert t.manifest() == before
    t.upsert(frame(spark, []), batch=("s", 1))
    assert t.manifest()["files"] == before["files"] and t.manifest()["batches"] == {"s": 1}
    t.upsert(frame(spark, [(f"m{i:03}", i, "", 0) for i in range(200)]), batch=("s", 2))
    assert len(t.manifest()["files"]) >= 8 and t.read().count() == 201
    t.delete(t.read())
    assert t.read().count() == 0
    t.upsert(frame(spark, [("x", 1, "back", 0)]))
    assert contents(t) == {("x", 1): "back"}


def test_a_second_writer_starts_over(spark, tmp_path, monkeypatch):
    a, b = (KeyedTable(spark, str(tmp_path / "t"), ["a"]) for _ in range(2))
    a.upsert(frame(spark, [("x", 1, "", 0)]))
    first, calls = KeyedTable._commit, []

    def late(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == 1:
            b.upsert(frame(spark, [("y", 2, "", 0)]))
        return first(self, manifest)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    assert a.upsert(frame(spark, [("z", 3, "", 0)])) == 3
    assert {r.a for r in a.read().collect()} == {"x", "y", "z"} and calls == [2, 2, 3]
    with pytest.raises(Conflict):
        first(a, {"version": 3})


def test_graph(spark, tmp_path):
    n, e = KeyedTable(spark, str(tmp_path / "n"), ["id"]), KeyedTable(spark, str(tmp_path / "e"), ["source", "relation", "target"])
    nodes = lambda *ids: spark.createDataFrame([(i, i.upper()) for i in ids], "id string, label string")
    edges = lambda *pairs: spark.createDataFrame([(s, "r", t, "d") for s, t in pairs], "source string, relation string, target string, desc string")
    keyed.upsert_graph(n, e, nodes("a", "b"), edges(("a", "b"), ("a", "ghost")), batch=("g", 0))
    keyed.upsert_graph(n, e, nodes("c"), edges(("c", "a"), ("ghost", "c")), batch=("g", 1))
    assert {(r.source, r.target) for r in e.read().collect()} == {("a", "b"), ("c", "a")}
    assert n.read().agg(F.count("*")).first()[0] == 3


def test_stream(spark, tmp_path):
    from tomegraph.streaming import incremental

    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"])
    for i, rows in enumerate(([("p", 1, "old", 0)], [("p", 1, "new", 1), ("q", 2, "", 1)])):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    incremental.upserts(s, t, f"{tmp_path}/cp", "s", "ord").trigger(availableNow=True).start().awaitTermination(120)
    assert set(contents(t)) == {("p", 1), ("q", 2)}
    assert t.manifest()["batches"] == {"s": 1}
