import random
from collections import deque

import pytest
from tomegraph.operators import landmarks


def walked(edges, undirected):
    """Plain search: (start, end) -> distance."""
    near, ids = {}, set()
    for a, b in edges:
        if a is None or b is None:
            continue
        ids |= {a, b}
        near.setdefault(a, set()).add(b)
        if undirected:
            near.setdefault(b, set()).add(a)
    out = {}
    for s in ids:
        d, q = {s: 0}, deque([s])
        while q:
            at = q.popleft()
            for b in near.get(at, ()):
                if b not in d:
                    d[b] = d[at] + 1
                    q.append(b)
        out |= {(s, t): v for t, v in d.items()}
    return out, near, ids


@pytest.mark.parametrize(("seed", "n", "m", "undirected", "limit"), [(1, 25, 45, False, None), (2, 25, 30, True, None), (3, 20, 90, False, 2), (4, 30, 34, True, 5)])
def test_random_graphs(spark, seed, n, m, undirected, limit):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(n):02}", f"n{r.choice((0, 1, r.randrange(n))):02}") for _ in range(m)] + [("n00", "n00"), ("n01", None), (None, "n02")]
    edges += edges[:5]
    want, near, ids = walked(edges, undirected)
    want = {k: d for k, d in want.items() if limit is None or d <= limit}
    table = landmarks.labels(spark.createDataFrame(edges, "source string, target string"), limit, undirected).cache()
    pairs = spark.createDataFrame([(a, b) for a in sorted(ids) for b in sorted(ids)] + [("n00", "n01"), ("n00", None)], "start string, end string")
    assert {(x.start, x.end): x.d for x in landmarks.distances(table, pairs, limit).collect()} == want
    got = landmarks.routes(table, pairs, limit).collect()
    assert len(got) == len(want)
    for x in got:
        assert (x.path[0], x.path[-1], len(x.path) - 1) == (x.start, x.end, want[x.start, x.end])
        assert all(b in near[a] for a, b in zip(x.path, x.path[1:]))
    # each label is a distance, and none is kept that a higher hub makes needless
    for x in table.collect():
        assert x.d == want[(x.hub, x.id) if x.side != "out" else (x.id, x.hub)]
    assert table.count() < (1 if undirected else 2) * len(want)
    table.unpersist()


def test_no_links(spark):
    table = landmarks.labels(spark.createDataFrame([], "source string, target string"))
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "start string, end string")
    assert [tuple(x) for x in landmarks.routes(table, pairs).collect()] == [("a", "a", 0, ["a"])]


def test_a_star_labels_each_leaf_once(spark):
    edges = [("hub", f"n{i}") for i in range(200)]
    table = landmarks.labels(spark.createDataFrame(edges, "source string, target string"), undirected=True)
    assert table.count() == 200


def test_nodes_with_the_same_labels_are_asked_once(spark):
    """200 leaves of two hubs make 10 000 pairs, but only the four meetings of their sets are worked out."""
    edges = [(f"h{i % 2}", f"n{i:03}") for i in range(200)] + [("h0", "h1")]
    table = landmarks.labels(spark.createDataFrame(edges, "source string, target string"), undirected=True)
    pairs = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a in range(100) for b in range(100, 200)] + [("n000", "n000"), ("z", "z")], "start string, end string")
    out, starts, ends, best = landmarks._best(table, pairs, None)
    assert starts.select("set").distinct().count() == 2 and best.count() <= 4
    assert {(x.start, x.end): x.d for x in out.collect()} == {("z", "z"): 0, ("n000", "n000"): 0} | {(f"n{a:03}", f"n{b:03}"): 2 + (a + b) % 2 for a in range(100) for b in range(100, 200)}
