import hashlib
import re

import pytest

from tests.llm.fixtures import documents, odd_rows, prose
from tests.harness import oracle, rows
from tomegraph.llm import decontamination as D
from tomegraph.llm.common import identified


def index_of(docs):
    return D.build_index(identified(docs))


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if found := phrases.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, prose(500, 40)), (2, prose(501, 13)), (10, prose(502, 4)), (3, prose(500, 40)), (None, prose(503, 20)), (5, None), (6, "--- !"), (7, "Ünï-☃ 漢字 x1")]


def data():
    passage = prose(500, 40)
    return odd_rows() + [
        (600, f"{prose(1, 30)} {passage} {prose(2, 300)}"), (601, passage.upper().replace(" ", ", ")), (602, " ".join(passage.split()[:12])), (603, " ".join(passage.split()[5:18])),
        (604, f"{prose(3, 900)} {prose(502, 4)}"), (605, prose(502, 4)), (606, f"{prose(503, 20)} {prose(503, 20)}"), (607, "ünï ☃ 漢字 X1"), (608, " ".join([prose(501, 13)] * 5)), (609, f"{passage[:-1]}"),
    ]


@pytest.mark.parametrize(("tokens", "block"), [(500_000, 8 << 20), (50, 8 << 20), (500, 10)])
def test_verdicts(spark, tokens, block, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK_BYTES", block)
    monkeypatch.setattr(D, "SEGMENT_TOKENS", tokens)
    docs = documents(spark, data() + data()[-6:] * 3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, segment string")
    got = D.verdicts(index_of(docs), items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data() + data()[-6:] * 3, ITEMS)


def test_proximity(spark):
    docs = documents(spark, [(1, "the old x mill stands y here"), (2, "mill old the"), (3, "the old mill stands here")])
    items = spark.createDataFrame([(1, "the old mill stands here")], "item_id long, text string")
    index = index_of(docs)
    near = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in D.matches(index, items, 13, slop=2).collect()}
    assert near == {1: [(0, 7)], 2: [], 3: [(0, 5)]}
    assert {r.doc_id: len(r.spans) for r in D.matches(index, items, 13, slop=1).collect()} == {1: 0, 2: 0, 3: 1}


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = documents(spark, [(1, "a")])
    assert D.verdicts(index_of(none.where("doc_id < 0")), items).count() == 0
    assert [tuple(r)[1:4] for r in D.verdicts(index_of(none), items.limit(0)).collect()] == [(1, 0, 0)]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = D.op9_decontamination(spark, sf).toPandas()
    assert sorted((tuple(r) for r in got.itertuples(index=False)), key=repr) == brute(docs, items)
    assert rows(got) == rows(oracle(D.ORACLE["op9_decontamination"], sf))


def test_null_ids(spark):
    docs = documents(spark, [(None, prose(500, 40)), (2, "a"), (None, "b"), (8, prose(1, 40)), (8, prose(500, 40))])
    got = D.verdicts(index_of(docs), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in got) == [(0, False), (0, True), (2, False), (8, False), (8, True)]


def test_many_phrases_in_chunks(spark, monkeypatch):
    """Places are tried in chunks; frequent terms in phrases change nothing."""
    monkeypatch.setattr(D, "CHUNK", 7)
    texts = [(i, " ".join(["ka", "lo"] * 30) + prose(i, 20)) for i in range(12)]
    items = [(1, "ka lo " * 9), (2, "lo ka lo"), (3, "ka"), (4, prose(3, 20)), (5, "ka ka lo")]
    got = D.verdicts(index_of(documents(spark, texts)), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(texts, items)


def test_one_python_step_at_a_time(spark, monkeypatch):
    """No table is written by a plan with two Python steps: each would hold a worker of every task."""
    steps = []
    plain = D.materialise

    def told(df, *a, **k):
        steps.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return plain(df, *a, **k)

    monkeypatch.setattr(D, "materialise", told)
    data = odd_rows() + [(100, prose(500, 40))]
    got = D.verdicts(index_of(documents(spark, data)), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, ITEMS)
    assert max(steps) == 1
