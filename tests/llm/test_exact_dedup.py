import hashlib
import re

import numpy as np
import pytest

from tests.harness import oracle, rows
from tests.llm.fixtures import documents, odd_rows
from tomegraph.llm import exact_dedup as X
from tomegraph.llm import fuse
from tomegraph.llm.common import identified


def brute(data):
    text = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, (_, t) in enumerate(data)}
    keep, n = {}, {}
    for i, (d, _) in enumerate(data):
        keep[text[i]] = min(d, keep.get(text[i], d))
        n[text[i]] = n.get(text[i], 0) + 1
    return sorted((d, keep[text[i]], n[text[i]], d == keep[text[i]], hashlib.sha256(text[i].encode()).hexdigest()) for i, (d, _) in enumerate(data))


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_groups(spark, batches):
    data = odd_rows()
    got = X.exact_groups(documents(spark, data), batches)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_bytes_decide_when_digests_are_equal(spark):
    data = odd_rows()
    got = X.exact_groups(documents(spark, data), 2, digest_bytes=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)
    assert sorted(tuple(r) for r in X.exact_groups(documents(spark, [(i, f"t{i}") for i in range(600)]), 2, digest_bytes=1).collect()) == brute([(i, f"t{i}") for i in range(600)])


@pytest.mark.parametrize("batches", [1, 2, 3, 4, 5])
def test_sizes_with_any_number_of_batches(spark, batches):
    """Groups that reach over all slices, repeated ids among them."""
    data = [(i // 2, f"text {i % 7}  x") for i in range(210)] + [(500 + i, f"single {i}") for i in range(20)] + [(900, "text 1 x")] * 5
    got = X.exact_groups(documents(spark, data), batches)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_a_task_moves_a_body_once(spark):
    """Of a group of thousands of copies at most one body a task is written."""
    known = identified(documents(spark, [(i, "the same text  again") for i in range(4000)]).repartition(4))
    rows = X.digests(known, 1)
    shared = X._grouped(rows, "keep_id", "n").where("n > 1")
    assert X._bodies(known, shared).count() <= 8


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_memory_of_bodies(spark, held, monkeypatch):
    monkeypatch.setattr(X, "HELD_BYTES", held)
    data = odd_rows() * 2
    assert sorted((tuple(r) for r in X.exact_groups(documents(spark, data), 2, digest_bytes=1).collect())) == brute(data)


def test_empty(spark):
    assert X.exact_groups(documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_texts_by_join_beyond_the_filter(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    data = odd_rows()
    assert sorted(tuple(r) for r in X.exact_groups(documents(spark, data)).collect()) == brute(data)


def test_one_digest_meets_many(spark, tmp_path, monkeypatch):
    """A small snapshot and a large batch: the batch's share of the only bucket goes in parts; a small batch reads its shelf alone."""
    monkeypatch.setattr(X, "BUCKET_KEYS", 500)
    many = X._grouped(X.digests(X.identified(documents(spark, [(i, f"text {i}") for i in range(6000)])), 1), "keep_id", "n")
    one = many.where("keep_id = 17")
    small = X.Snapshot.build(one, str(tmp_path / "one"))
    assert (small.buckets, small.parts(6000)) == (1, 12)
    passed = small.screen(many)
    sizes = many.groupBy(X.F.pmod(X.F.shiftright("key", 40), X.F.lit(12)).alias("part")).count()
    assert sizes.agg(X.F.max("count")).first()[0] < 800
    new = passed.withColumnsRenamed({"keep_id": "new_id", "n": "new_n"})
    assert [(r.new_id, r.keep_id) for r in small.known(new).collect()] == [(17, 17)]
    large = X.Snapshot.build(many, str(tmp_path / "many"))
    assert large.buckets == 12
    hit = large.known(large.screen(one.withColumnsRenamed({"keep_id": "new_id", "n": "new_n"})))
    assert [(r.new_id, r.keep_id) for r in hit.collect()] == [(17, 17)]
    assert "PartitionFilters: [isnotnull(shelf" in hit._jdf.queryExecution().toString()
    assert large.known(large.screen(new.limit(0))).count() == 0


def test_query(spark, sf):
    assert rows(X.op10_exact_dedup(spark, sf).toPandas()) == rows(oracle(X.ORACLE["op10_exact_dedup"], sf))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 50_000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 62, n).astype(np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, r.integers(0, 1 << 62, 100_000).astype(np.uint64)).mean() < 2e-4


def test_null_ids(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_groups(documents(spark, [(None, "a"), (3, "a"), (None, "b"), (4, None)])).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, False), (4, 4, 1, True)}
