import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import documents, odd_rows, prose
from tomegraph.llm import quality as Q
from tomegraph.llm import url_filter as U


def test_quality_on_held_out(spark, sf):
    got = Q.op3_quality_classifier(spark, sf.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    m = got.merge(labels, on="doc_id").query("held_out")
    assert (m["predicted"] == m["quality"]).mean() > 0.93


def test_quality_odd_tables(spark):
    docs = documents(spark, odd_rows())
    few = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = Q.scores(docs, few).collect()
    assert len(got) == len(odd_rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert Q.scores(docs.where("doc_id < 0"), few).count() == 0
    assert Q.scores(docs, few.limit(0)).first().score == 0.5
    good = [(i, prose(i, 60)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int")
    kept = Q.Classifier.fit(documents(spark, good + bad), labels).accepted(documents(spark, good + bad))
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(200))) > 195
    assert len(ids - set(range(200))) < 5
    assert kept.columns == docs.columns


def test_accepted_texts_do_not_come_back_from_python(spark):
    """Only the numbers of rejected rows do: an unbounded batch of whole texts took a gigabyte beside the heap."""
    rows = [(i, prose(i, 30)) for i in range(40)] + [(7, None), (None, prose(99, 5))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = Q.Classifier.fit(docs, labels).accepted(docs, cut=0.0)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))



def test_vectors_are_the_sum_over_all_documents(spark):
    docs = documents(spark, odd_rows())
    a = Q.word_vectors(docs)
    b = Q.word_vectors(docs.repartition(5))
    assert np.array_equal(a, b)


def test_vectors_by_hand():
    """Each slot's sum of the index vectors of words at most WINDOW places away in the same document."""
    texts = ["a b c a a!! 12 X", "", "one", " ".join(prose(3, 400).split()), "b a"]
    slots, index = Q.Slots(), Q.index_vectors()
    want = np.zeros((Q.SLOTS, Q.WIDTH))
    for t in texts:
        w = Q.codes(t, slots)
        for i, x in enumerate(w):
            for j in range(max(0, i - Q.WINDOW), min(len(w), i + Q.WINDOW + 1)):
                want[x] += index[w[j]] if j != i else 0
    got = np.zeros_like(want)
    wide = np.vstack([index, np.zeros((1, Q.WIDTH))]).astype(np.int8)
    for chunk in (Q.CHUNK, 50):
        got[:] = 0
        for _, _, word, bounds in Q._batches(texts, slots):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(Q, "CHUNK", chunk)
                Q._context(word, bounds, wide, got)
        assert np.array_equal(got, want)


def test_words_of_a_column_at_once():
    """Equal to the words one by one, from Arrow's bytes; only long words and runs of marks are looked up singly."""
    r = np.random.default_rng(5)
    odd = ["".join(r.choice(list("aAbZ09 \t\n!?.,\x00\x1c\x85\xe9\xc9\u65e5 "), 60)) for _ in range(300)]
    sizes = [" ".join((w * n)[:n] for w in ("A", "a", "Ab", "aB", "1", "!", "\xc9", "A\xc9", "\xe9A") for n in range(1, Q.LONG + 9))]
    texts = [None, "", *odd, *sizes, "THE The tHE", "", None, "x" * (7 * Q.CHUNK), *(prose(i, 90) for i in range(300)), ""]
    for column in (texts, pa.array(texts), pa.array(["cut", None, *texts, "off"], pa.large_string()).slice(2, len(texts))):
        one, at = Q.Slots(), 0
        for lo, hi, word, bounds in Q._batches(column, Q.Slots()):
            assert lo == at and len(bounds) == hi - lo + 1 and bounds[-1] == len(word)
            for i in range(lo, hi):
                assert np.array_equal(word[bounds[i - lo] : bounds[i - lo + 1]], Q.codes(texts[i], one))
            at = hi
        assert at == len(texts)
    singly = Q.Slots()
    assert sum(len(w) for _, _, w, _ in Q._batches(pa.array([prose(i, 400) + " THE 12, \xc9t\xe9." for i in range(50)]), singly)) > 20_000
    assert not singly


def test_pooled_by_hand():
    texts = ["a b c a a!! 12 X", None, "one", prose(3, 400)] + [prose(i, 3) for i in range(100)]
    slots, index = Q.Slots(), Q.index_vectors()
    vectors = np.random.default_rng(1).normal(size=index.shape).astype(np.float32)
    got = Q.pooled(texts, vectors, index, slots)
    for row, t in zip(got, texts, strict=True):
        w = Q.codes(t, slots)
        v = vectors[w].astype(float)
        want = np.concatenate([index[w].mean(0), v.mean(0), v.std(0)]) if len(w) else np.zeros(3 * Q.WIDTH)
        assert np.allclose(row, [*want, np.log1p(len(w))], atol=1e-5)


def test_equal_ids_are_learnt_alike(spark):
    """Rows of one id with different texts: the scores don't depend on how the rows are dealt."""
    rows = [(i, prose(i, 40)) for i in range(60)] + [(100 + i, prose(i, 40).upper()) for i in range(60)] + [(i, prose(900 + i, 9)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows[:120]], "doc_id long, quality int")
    docs = documents(spark, rows)
    score = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in Q.scores(df, labels).collect())
    assert score(docs) == score(docs.repartition(7, "n_chars"))


def test_scores_are_calibrated(spark, sf):
    """Among held-out documents a score means about the share of good ones."""
    d = sf.replace("0.001", "0.1")
    got = Q.op3_quality_classifier(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    bins = np.minimum((got["score"] * 5).astype(int), 4)
    gap = sum(abs(g["score"].mean() - g["quality"].mean()) * len(g) for _, g in got.groupby(bins)) / len(got)
    assert gap < 0.03


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.DOTALL)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len) if fits else None


URLS = [None, "", "no scheme", "http://", "://x", "http://A.EXAMPLE.NET/en/x", "http://example.net/EN/", "http://net", "http://net/", "http://xnet/", "https://a.org/fr/?q=1#z", "http://b.example.com/de/x?y://z", "http://example.com/de", "http://ex\nample.net/en/\nx", "http://h?://net/", "ftp://É.org/fr/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>", "c") for i, u in enumerate(URLS * 3)], "page_id long, url string, html string, score string")
    got = U.judge(df, U.RULES).collect()
    assert len(got) == 3 * len(URLS)
    for r in got:
        host, path = split(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path))
        assert r.verdict == dict(RULES).get(r.rule, r.verdict)
        assert r.verdict in ("allow", "block")
    assert U.judge(df.limit(0), U.RULES).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_long_and_odd_suffixes(spark, limit, monkeypatch):
    """Suffixes too long to be sent to the tasks are joined, with the same verdicts."""
    urls = [(i, f"http://h{i % 9}.example.{('net', 'org', 'com')[i % 3]}/{('en', 'de', 'fr')[i // 3 % 3]}/{'x' * (i % 13)}{i * 7919 % 1000}") for i in range(200)]
    pages = spark.createDataFrame(urls + [(900, "http://a." + "z" * 5000), (901, "http://a." + "z" * 5000 + "/en/"), (902, None)], "page_id long, url string")
    short = {r.page_id: (r.verdict, r.score) for r in U.judge(pages.where("page_id < 900"), U.RULES).collect()}
    if limit is not None:
        monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    got = {r.page_id: (r.verdict, r.score) for r in U.judge(pages, U.RULES).collect()}
    assert len(got) == 203
    assert {k: v for k, v in got.items() if k < 900} == short


def test_a_repeated_url_is_one_training_row(spark):
    urls = [(i, "http://a.example.net/x/") for i in range(500)] + [(600 + i, f"http://b{i}.example.org/fr/{i}") for i in range(40)]
    _, y, host = U.training_rows(U.ruled_urls(spark.createDataFrame(urls, "page_id long, url string"), U.RULES), 30)
    assert len(host) == 30
    assert (host == "a.example.net").sum() <= 1


def test_verdicts_on_held_out_hosts(spark):
    """Labels that go with the looks of a URL are learnt over hosts, within one suffix too."""
    r = np.random.default_rng(3)
    urls, label = [], {}
    for i in range(900):
        bad = r.random() < 0.5
        host = f"h{r.integers(200)}.example.com"
        path = f"{r.integers(10**12)}/{r.integers(10**9)}?a={r.integers(99)}&b={r.integers(99)}" if bad else "/".join(prose(int(r.integers(999)), 3).split())
        urls.append((i, f"http://{host}/{'bad' if bad else 'good'}/{path}"))
        label[urls[-1][1]] = bad
    rules = {"com/bad/": "block", "com/good/": "allow"}
    x, y, host = U.training_rows(U.ruled_urls(spark.createDataFrame(urls, "page_id long, url string"), rules), 20_000)
    fold = np.array([int(h[1:].split(".")[0]) % 4 == 0 for h in host])
    m = U.BoostedTrees().fit(x[~fold], y[~fold])
    assert ((m.predict(x[fold]) > 0.5) == y[fold]).mean() > 0.97


def test_suffix_alone_decides_nothing(spark, sf):
    """Pages of one top-level domain that no rule decides get both verdicts."""
    got = U.judge(spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet"), U.RULES).where("rule IS NULL").toPandas()
    for suffix in ("com", "org"):
        assert set(got["verdict"][got["host"].str.endswith(suffix)]) == {"allow", "block"}


def test_trees_learn():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = U.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    assert (U.BoostedTrees().fit(x[:5], np.ones(5)).predict(x) > 0.99).all()


@pytest.mark.parametrize("name", ["op4_url_filter"])
def test_query(spark, sf, name):
    src = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = getattr(U, name)(spark, sf).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {p: (*split(u), rule(*split(u))) for p, u in src.items()}
