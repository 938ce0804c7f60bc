"""Work on the rows of a small file is dealt over tasks."""

import pytest

from tomegraph.operators import flatten, traverse
from tomegraph.plans.queries import QUERIES
from tomegraph.session import spread


def test_spread_keeps_rows(spark):
    df = spark.range(0, 1000, 1, 1)
    got = spread(df)
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert max(map(len, got.rdd.glom().collect())) <= 1000 // got.rdd.getNumPartitions() + 10


@pytest.mark.parametrize("name", ["tags_nested", "tags_single_pass"])
def test_tags_of_one_file(spark, sf, name):
    sizes = QUERIES[name](spark, sf).rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 2


def test_documents_of_one_file(spark, monkeypatch):
    made = []

    class Seen(flatten.Levels):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self.path)

    monkeypatch.setattr(flatten, "Levels", Seen)
    docs = spark.range(0, 400, 1, 1).selectExpr("string(id) AS doc_id", """'[{"type": "section", "name": "a", "entries": ["x", "y"]}]' AS body""")
    assert {(r.doc_id, r.content) for r in flatten.flatten(docs).collect()} == {(str(i), "x\ny") for i in range(400)}
    for level in (0, 1):
        assert len(spark.read.parquet(f"{made[0]}/level-{level}").inputFiles()) > 1


def test_accumulated_in_even_shares(spark):
    """The tasks that sort before they combine hold a share of the rows each, whatever the files."""
    own = spark.range(0, 3000, 1, 1).selectExpr("'d' AS doc_id", "array(0, int(id % 7), int(id)) AS path", "'i' AS id", "string(id) AS label", "0 AS ord")
    got = traverse.accumulated(own)
    assert got.count() == 1 + 7 + 3000
    assert {r.label for r in got.where("size(at) < 3").collect()} == {str(i) for i in range(7)}
    assert "RoundRobinPartitioning" in got._jdf.queryExecution().executedPlan().toString()
