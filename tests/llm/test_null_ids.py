"""Rows without an id: nothing crashes and no row is lost."""

from tests.llm.fixtures import documents, prose
from tomegraph.llm import line_dedup, packing, pii, quality, simhash, token_file
from tomegraph.llm.common import scratch_path
from tomegraph.llm.tokens import vocabulary


def test_all(spark):
    base = prose(1, 60)
    docs = documents(spark, [(None, base), (None, "b"), (3, base), (4, None)])
    assert {(r.doc_id, r.component_id) for r in simhash.near_components(docs).collect()} >= {(None, 3), (3, 3), (4, 4)}
    assert packing.pack(packing.pieces(docs, vocabulary(), 1, 64), 64).select("doc_id").distinct().count() == 3
    assert pii.sanitise(docs).count() == 4
    assert line_dedup.clean(docs).count() == 4
    assert quality.scores(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).count() == 4
    assert sorted((r.group_id is None, r.group_id or 0) for r in simhash.near_groups(docs).collect()) == [(False, 3), (False, 3), (False, 4), (True, 0)]
    rows = token_file.read(token_file.write(docs, scratch_path(spark, "t"), vocabulary(), 2)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0), (False, 0), (True, 3), (True, 4)]
