import re

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import changed, documents, odd_rows, prose
from tomegraph.llm import golay
from tomegraph.llm import simhash as S
from tomegraph.llm.common import identified


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])


def brute_print(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components_of_fingerprints(spark):
    base = prose(50, 400)
    data = odd_rows() + [(100 + i, changed(base, i, 1 + i % 3)) for i in range(25)] + [(200, base)]
    fp = {d: brute_print(t) for d, t in data}
    want = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_components(documents(spark, data)).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


@pytest.mark.parametrize("bucket", [2, 10_000])
def test_links_within_two_bits(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "PAIR_BUCKET", bucket)
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(15):
            x = c
            for b in r.choice(64, r.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    ids = sorted(fps)
    want = roots(ids, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in ids], "fp long")
    found = {(a % (1 << 64), b % (1 << 64)) for a, b in S.linked(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    got = roots(ids, lambda a, b: (a, b) in found or (b, a) in found)
    assert got == want


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 23, 400)
    for d in range(3):
        y = x.copy()
        for i in range(len(x)):
            for b in r.choice(23, d, replace=False):
                y[i] ^= 1 << int(b)
        a, b = ({(int(p), int(k)) for p, k in zip(*golay.keys(v), strict=True)} for v in (x, y))
        assert {p for p, _ in a & b} == set(range(len(x)))
    row, _ = golay.keys(x)
    assert set(np.bincount(row)) <= {1, 6}


def jaccard(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("bucket", [1, 32])
def test_near_groups(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "PAIR_BUCKET", bucket)
    data = dict(odd_rows())
    for k, n in enumerate((40, 80, 150, 400)):
        base = prose(70 + k, n)
        for i in range(6):
            data[1000 + 10 * k + i] = changed(base, i, min(i, n // 40))
    ids = sorted(data)
    want = roots(ids, lambda a, b: jaccard(data[a], data[b]) >= 0.8 or not shingles(data[a], 5) and not shingles(data[b], 5))
    got = {r.doc_id: r.group_id for r in S.near_groups(documents(spark, list(data.items()))).collect()}
    assert got == want
    assert S.near_groups(documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 to 0.82: nearly all share a key."""
    hit = total = 0
    for seed in range(400):
        r = np.random.default_rng(seed)
        n = 450
        pool = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        common = round(n * 2 * 0.81 / 1.81)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        x, y = S.band_keys(np.stack([S.first_votes(a), S.first_votes(b)]))
        total += 1
        hit += bool((x == y).any())
    assert hit / total > 0.99


def test_rows_of_equal_and_no_id(spark):
    """Rows of one id are told apart, the first of the smallest id stays, rows without an id come last."""
    a, b = prose(1, 80), prose(2, 80)
    data = [(None, a), (8, a), (5, b), (5, a), (5, a), (None, b), (None, "other words here"), (None, "other words here")]
    known = identified(documents(spark, data).coalesce(1))
    got = sorted(S.near_rows(known).collect(), key=lambda r: r.row)
    place = [r.row for r in got]
    assert [place.index(r.keep_row) for r in got] == [3, 3, 2, 3, 3, 2, 6, 6]
    assert [r.group_id for r in got] == [5, 5, 5, 5, 5, 5, None, None]


def crowd(spark, texts):
    """Ids, sets and a single key of the given texts."""
    data = [(i, t) for i, t in enumerate(texts)]
    known = identified(documents(spark, data).coalesce(1))
    rows = known.select("row", "doc.doc_id").collect()
    keys = spark.createDataFrame([(1, r.row, len(data)) for r in rows], "key long, id long, n long")
    return known, keys, {r.row: r.doc_id for r in rows}


@pytest.mark.parametrize("block", [5, 256])
def test_crowds_are_exact(spark, block, monkeypatch):
    """Hub and spokes, chains, small groups and strangers under one key connect as all pairs do."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "PAIR_BUCKET", 1)
    base, far = prose(400, 60), prose(401, 90)
    texts = [changed(base, i, 1) for i in range(40)] + [base] + [changed(far, 50 + i, 1 + i % 3) for i in range(25)] + [prose(500 + i, 30 + i) for i in range(20)]
    chain = prose(402, 100)
    for i in range(12):
        chain = changed(chain, 900 + i, 1)
        texts.append(chain)
    known, keys, doc = crowd(spark, texts)
    want = roots(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    links = {(doc[r.a], doc[r.b]) for r in S.similar_links(known, keys, 5, 0.8).collect()}
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
    assert roots(range(len(texts)), lambda a, b: (a, b) in links or (b, a) in links) == want


def test_crowd_of_near_copies_stays_linear(spark, monkeypatch):
    """20 000 near copies, half of them linked with each other by the original alone: no blocks of pairs."""
    base = prose(77, 60)
    words = base.split()
    texts = [" ".join([*words[: i % 60], f"n{i}", *words[i % 60 + 1 :]]) for i in range(20_000)] + [base]
    rows = []
    spread = S._spread
    monkeypatch.setattr(S, "_spread", lambda *a: rows.append(spread(*a).count()) or spread(*a))
    groups = S.near_groups(documents(spark, list(enumerate(texts)))).collect()
    assert {r.group_id for r in groups} == {0}
    assert sum(rows) < 3 * len(texts)


def test_fingerprint_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: brute_print(t) for d, t in docs.items()}
    root = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = S.op5_simhash_near_dedup(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {d: (f"{fp[d]:016x}", root[d]) for d in fp}
