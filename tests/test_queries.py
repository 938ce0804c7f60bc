import pytest

import __spark_entry__ as entry
from tests.harness import oracle, rows
from tomegraph.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        want = oracle(ORACLE[name], sf)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["seed_rank", "source_id", "relationship", "target_id", "line"]
    assert df.count() == 9
