from pyspark.sql import functions as F
from tomegraph.operators import graph, ranks


def test_ranks_over_many_partitions(spark):
    t = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), "id")
    got = ranks.numbered(t.repartition(5).orderBy("k")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert ranks.numbered(t.where("id < 0").orderBy("k")).count() == 0


def test_running_sums(spark):
    rows = [(i, None if i % 5 == 0 else i % 7) for i in range(1000)]
    t = spark.createDataFrame(rows, "id long, v long").repartition(6).orderBy("id")
    got = {r.id: r.total for r in ranks.running(t, F.col("v")).collect()}
    want, total = {}, 0
    for i, v in rows:
        want[i] = total = total + (v or 0)
    assert got == want
    assert ranks.running(t.where("id < 0"), F.col("v")).count() == 0


def test_no_one_task_window(spark):
    t = spark.range(0, 2000, 1, 4).select(F.col("id").alias("ord"), F.lit("ab").alias("label"))
    kept = graph.within_chars(t, "label", 101)
    assert sorted(r["ord"] for r in kept.collect()) == list(range(50))
    assert "SinglePartition" not in kept._jdf.queryExecution().toString()
