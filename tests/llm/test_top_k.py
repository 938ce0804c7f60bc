import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.harness import oracle, rows
from tomegraph.llm import top_k

VECTORS = "label int, embedding array<double>, vec_id long, row string"


def brute(rows, k, scale=256):
    able = [(i, v, [math.floor(scale * c) for c in e]) for i, (_, e, v, _) in enumerate(rows) if e is not None and all(c is not None and math.isfinite(c) and math.isfinite(scale * c) for c in e)]
    out = []
    for qi, qv, q in able:
        if qv is None or qv % 50:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=False)))), v, i) for i, v, x in able if i != qi]
        scored.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0, t[2]))
        out += [(qv, rank, v, s) for rank, (s, v, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def answer(spark, rows, k=5):
    got = top_k.exact_top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", block)
    r = random.Random(block)
    rows = [(1, [r.gauss(0, 1) for _ in range(12)], i, "x") for i in range(300)]
    hot = [0.5, -1.0, 2.0] + [0.1] * 9
    rows += [(2, hot, 1000 + i, "hot") for i in range(150)]  # a third of the rows alike, queries among them
    assert answer(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0, "a"), (1, [1.0, None], 50, "a"), (1, [nan, 1.0], 100, "a"), (1, [inf, 1.0], 150, "a"), (1, [1e307, 1.0], 200, "a"), (1, [], 250, "a"), (1, [1.0], 300, "a"),
        (1, [1.0, -2.0, 3.0], 350, "a"), (1, [1.0, -2.0, 3.0], 350, "a"), (1, [-1.0, 0.001, -0.001], 7, "a"), (1, [4.0, 4.0], None, "a"), (1, [4.0, 4.0], 8, "a"), (1, [1e6, 1e-9], 400, "a"),
    ]
    assert answer(spark, rows, 20) == brute(rows, 20)
    assert answer(spark, rows, 2) == brute(rows, 2)
    assert answer(spark, rows[:1]) == answer(spark, rows[:0]) == []


def test_components_beyond_doubles_that_are_exact(spark):
    r = random.Random(3)
    rows = [(1, [r.choice([1e13, -3e12, 7.0, 1e300 if i % 9 == 0 else 0.25]) * r.random() for _ in range(4)], i * 10, "a") for i in range(60)]
    assert answer(spark, rows) == brute(rows, 5)
    rows = [(1, [1e7 * r.random() - 3e6 for _ in range(6)], i * 10, "a") for i in range(60)]
    assert answer(spark, rows) == brute(rows, 5)


def test_reading_stops_early():
    r = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([r.normal(0, 0.05, (400, 8)) + c for c in (np.eye(8)[:4] * 2)]))
    order = np.argsort(x, axis=0, kind="stable")
    block = top_k.Block(len(x), 8, np.arange(len(x)).astype("<i8").tobytes(), np.arange(len(x)).astype("<i8").tobytes(), np.take_along_axis(x, order, 0).T.astype("<f8").tobytes(), order.T.astype("<u2").tobytes())
    counts = {}
    j, i, s = top_k.search_block(block, x[:50], np.arange(50), np.full(50, -np.inf), 3, counts)
    for q in range(50):
        exact = x @ x[q]
        exact[q] = -np.inf
        best = np.sort(exact)[::-1][:3]
        assert sorted(s[j == q].tolist(), reverse=True)[:3] == best.tolist()
    assert counts["resolved"] < 0.5 * 50 * len(x)
    none = top_k.search_block(block, x[:50], np.arange(50), np.full(50, 1e9), 3, counts)
    assert len(none[0]) == 0


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "QUERY_BLOCK_BYTES", 300)
    r = random.Random(2)
    rows = [(1, [r.gauss(0, 1) for _ in range(6)], i * 10, "x") for i in range(100)]
    assert answer(spark, rows) == brute(rows, 5)


def test_query(spark, sf):
    assert rows(top_k.op11_exact_top_k(spark, sf).toPandas()) == rows(oracle(top_k.ORACLE["op11_exact_top_k"], sf))
