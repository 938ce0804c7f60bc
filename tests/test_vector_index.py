import numpy as np
import pytest
from pyspark.sql import functions as F
from tomegraph.operators import search
from tomegraph.operators.vector_index import VectorIndex

V = "id long, embedding array<float>"


def answers(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def clusters(n, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, 24))
    return [(i, (centre[i % 12] + 0.3 * r.normal(size=24)).tolist()) for i in range(n)]


def test_exact_mode_reads_few_cells(spark, tmp_path, monkeypatch):
    rows = clusters(1500)
    rows += [(5000 + i, rows[0][1]) for i in range(700)]  # a third of the table in one place
    v = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 24)], V)
    index = VectorIndex.build(v, str(tmp_path / "index"), cells=12)
    q = v.where("id % 100 = 0 AND embedding IS NOT NULL").withColumnRenamed("id", "query_id")
    looked = []
    over = VectorIndex._over_lists
    monkeypatch.setattr(VectorIndex, "_over_lists", lambda self, column, wanted, *a: looked.append((column, wanted.mean())) or over(self, column, wanted, *a))
    again = VectorIndex.open(spark, str(tmp_path / "index"))
    assert answers(again.search(q, 4, exact=True)) == answers(search.top_k_per_query(v.where("embedding IS NOT NULL"), q, 4))
    assert index.lists.count() == 2201 and index.model.probes < 12
    assert all(share < 0.6 for column, share in looked if column == "embedding")


@pytest.mark.parametrize("least", [0.9])
def test_recall_on_all_embeddings(spark, sf, tmp_path, least):
    """Directions without any clusters: the hardest case for cells."""
    e = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(e, str(tmp_path / "index"))
    true = {(r[0], r[2]) for r in answers(search.top_k_per_query(e, q, 10))}
    found = answers(index.search(q, 10))
    assert len({(r[0], r[2]) for r in found} & true) / len(true) >= least
    assert len(found) == len(true) and index.model.probes < len(index.model.centres)


def test_small_and_empty(spark, tmp_path):
    none = spark.createDataFrame([], V)
    index = VectorIndex.build(none, str(tmp_path / "none"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], V)
    index = VectorIndex.build(one, str(tmp_path / "one"))
    q = one.withColumnRenamed("id", "query_id")
    for exact in (True, False):
        assert answers(index.search(q, 3, exact=exact)) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
    assert index.search(q.limit(0), 3).count() == 0


def test_rows_held_don_t_grow_with_the_rows_seen():
    """Many small cells: a task holds k rows a query and a bounded number of new ones, ties and the query itself in their places."""
    r = np.random.default_rng(4)
    n, k, ids = 300, 5, r.permutation(30_000)
    score = np.round(r.normal(size=(n, len(ids))), 1)
    own = ids[:n]
    best, most = search.Best(n, k), 0
    best.FRESH = 10_000
    for lo in range(0, len(ids), 20):
        best.add(np.arange(n), own, ids[lo : lo + 20], score[:, lo : lo + 20])
        most = max(most, sum(len(x[0]) for x in best.held))
    assert most <= n * k + best.FRESH + n * 20
    query, row, found = best.rows()
    for i in range(n):
        order = [j for j in np.lexsort((-ids, -score[i])) if ids[j] != own[i]][:k]
        assert row[query == i].tolist() == ids[order].tolist() and found[query == i].tolist() == score[i, order].tolist()
