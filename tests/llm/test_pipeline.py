import hashlib

import corpus_pipeline as C
from tests.llm import test_decontamination, test_lines, test_simhash
from tests.llm.fixtures import changed, documents, prose
from tomegraph.llm.common import materialise


def test_stages(spark, sf):
    """Every stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in after}
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "quality_classifier":
            assert all(before[d] == t for d, t in texts.items())
            assert 0.7 < len(texts) / len(before) < 0.97
        elif name == "line_dedup":
            want = {r[0]: r for r in test_lines.brute(list(before.items()))}
            assert set(texts) == {d for d, x in want.items() if x[3]}
            assert all(hashlib.sha256(t.encode()).hexdigest() == want[d][4] for d, t in texts.items())
        elif name == "simhash_near_dedup":
            assert {(d, t) for d, t in texts.items()} == set(near_brute(list(before.items())))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(texts) == {r[0] for r in test_decontamination.brute(list(before.items()), items) if not r[5]}
    assert {r.doc_id for r in after} == set(texts)


def near_brute(rows):
    """Rows that stay: of each group of linked texts the smallest doc_id, then the first; rows without an id come last."""
    sets = [set(test_simhash.shingles(t, 5)) for _, t in rows]
    root = test_simhash.roots(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])) or not (sets[a] or sets[b]))
    groups = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0, i)
        groups[root[i]] = min(groups.get(root[i], key), key)
    return [rows[i] for _, _, i in groups.values()]


def test_equal_and_missing_ids(spark, sf):
    """Rows of one id or none are judged one by one, in every stage after the classifier and through all of them."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    base = prose(5, 90)
    data = [
        (8, prose(1, 50)), (8, item), (None, item), (None, prose(2, 50)), (5, base), (5, prose(3, 50)), (9, changed(base, 1, 1)), (None, changed(base, 2, 1)),
        (5, base), (7, "a line\nb line"), (7, "c line\nb line"), (None, "c line"), (4, None), (4, ""), (None, None),
    ]
    docs = documents(spark, data).coalesce(1)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)

    got = rows(C.without_repeated_lines(spark, docs, sf))
    want = test_lines.brute(data)
    assert sorted(((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in got), key=repr) == sorted(((r[0], r[4]) for r in want if r[3]), key=repr)
    got = rows(C.one_of_near_copies(spark, docs, sf))
    assert got == sorted(near_brute(data), key=repr)
    clean = lambda t: not test_decontamination.brute([(0, t)], items)[0][5]
    assert rows(C.without_benchmarks(spark, docs, sf)) == sorted(((d, t) for d, t in data if clean(t)), key=repr)
    through = docs
    for name, stage in C.STAGES[1:-1]:
        through = materialise(stage(spark, through, sf), name)
    texts = [t for _, t in rows(through)]
    assert prose(1, 50) in texts
    assert prose(2, 50) in texts
    assert prose(3, 50) in texts
    assert item not in texts
    assert sum(t in (base, changed(base, 1, 1), changed(base, 2, 1)) for t in texts) == 1
    assert C.packed(spark, through, sf).count() == len(texts)


def test_near_copies_over_the_whole_pipeline(spark, sf):
    """Of planted near copies at most a remnant is left: words that the first copy lacks."""
    base = [prose(3000 + i, 120) for i in range(20)]
    plain = [(i, f"{t}\n{prose(4000 + i, 30)}") for i, t in enumerate(base)]
    copies = [(100 + i, f"{changed(t, i, 3)}\n{prose(4000 + i, 30)}") for i, t in enumerate(base)]
    docs = documents(spark, plain + copies).coalesce(1)
    for name, stage in C.STAGES[1:-1]:
        docs = materialise(stage(spark, docs, sf), name)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(20)) <= set(left)
    # line dedup takes the equal line first, so what remains of a copy is its changed line, and near-dedup meets that without its companion
    assert all(left[d] == copies[d - 100][1].split("\n")[0] for d in left if d >= 100)


def test_run_is_registered(spark, sf):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is C.run
    assert [n for n, _ in C.STAGES][0] == "quality_classifier"
    assert C.run(spark, sf).columns[:3] == ["doc_id", "piece", "start"]


def test_odd_tables(spark, sf):
    none = documents(spark, [(1, "a")]).where("doc_id < 0")
    for _, stage in C.STAGES:
        assert stage(spark, none, sf).count() == 0
