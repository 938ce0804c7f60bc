import math
from fractions import Fraction

import numpy as np
import pytest
from tomegraph.llm import whitening

VECTORS = "label int, embedding array<double>, vec_id long, w string"


def numbers(e):
    return [max(-(2**62), min(2**62, math.floor(64 * c) + 1_000_000)) for c in e]


def exact(rows):
    """Rows that take part, their numbers, n, S and V as fractions."""
    able = [(v, e) for _, e, v, _ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    width = max((len(e) for _, e in able), default=0)
    x = [(v, numbers(e + [0.0] * (width - len(e)))) for v, e in able]
    n = len(x)
    s = [sum(r[d] for _, r in x) for d in range(width)]
    v = [[Fraction(sum(r[a] * r[b] for _, r in x), n) - Fraction(s[a] * s[b], n * n) for b in range(width)] for a in range(width)]
    return x, n, s, v


def checked(spark, rows, least_components):
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    x, n, s, v = exact(rows)
    vf = np.array([[float(c) for c in r] for r in v])
    e, axes = np.linalg.eigh(vf)
    e, axes = e[::-1], axes[:, ::-1]
    count = len({r.component for r in got})
    assert least_components <= count <= min(32, len(e))
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
    for c in range(1, count + 1):
        mine = by_component[c]
        assert len(mine) == n
        want = {}
        for vec_id, row in x:
            centred = np.array([float(Fraction(a * n - t, n)) for a, t in zip(row, s, strict=True)])
            deviation = sum((n * a - t) ** 2 for a, t in zip(row, s, strict=True))
            want.setdefault(vec_id, []).append((deviation, float(centred @ axes[:, c - 1] / math.sqrt(e[c - 1]))))
        rebuilt = {}
        for r in mine:
            assert r.n == n and r.identity_error < 1e-4
            assert int(r.deviation_digits) == (r.deviation if r.deviation is not None else int(r.deviation_digits))
            assert abs(r.explained - e[c - 1] / np.trace(vf)) <= 1e-4 * r.explained
            rebuilt.setdefault(r.vec_id, []).append((int(r.deviation_digits), r.whitened))
        assert {k: sorted(d for d, _ in z) for k, z in rebuilt.items()} == {k: sorted(d for d, _ in z) for k, z in want.items()}
        if all(abs(e[c - 1] - o) > 1e-6 * e[0] for i, o in enumerate(e) if i != c - 1):
            a = np.array([z for k in sorted(want) for z in sorted(y for _, y in want[k])])
            b = np.array([z for k in sorted(rebuilt) for z in sorted(y for _, y in rebuilt[k])])
            flipped = np.array([z for k in sorted(rebuilt) for z in sorted(-y for _, y in rebuilt[k])])
            assert min(np.abs(a - b).max(), np.abs(a - flipped).max()) < 1e-6
    return got


def test_equals_exact_arithmetic(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (400, 6)) @ np.diag([3, 1, 0.5, 0.2, 0.1, 0.05]) + 7
    rows = [(1, v.tolist(), i, "c") for i, v in enumerate(x)] + [(1, x[0].tolist(), 900 + i, "c") for i in range(150)]
    checked(spark, rows, 6)


def test_hidden_variance(spark):
    """Variance far below the mean's square, where sums of squares in doubles keep nothing."""
    r = np.random.default_rng(2)
    x = 1e9 + r.normal(0, 1, (200, 4)) * [4, 2, 1, 0.5]
    checked(spark, [(1, v.tolist(), i, "c") for i, v in enumerate(x)], 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1, "a"), (1, [1.0, None, 2.0], 2, "a"), (1, [nan], 3, "a"), (1, [inf, 1.0, 1.0, 1.0, 1.0], 4, "a"), (1, [], 5, "a"), (1, [2.0], 6, "a"), (1, [1.0, -2.0, 3.0], 7, "a"),
        (1, [1.0, -2.0, 3.0], 7, "a"), (1, [5.0, 4.5, -1.0], None, "a"), (1, [0.3, 9.0, 1.0], None, "a"),
    ]
    got = whitening.whiten(spark.createDataFrame([r for r in rows if r[2] is not None], VECTORS)).collect()
    assert len({r.vec_id for r in got}) == 3 and len(got) % 4 == 0
    assert all(r.n == 4 for r in got)
    full = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sum(r.vec_id is None for r in full) == 2 * 3
    assert whitening.whiten(spark.createDataFrame(rows[6:8], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(rows[:1], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e30 if i == 0 else float(i), 1.0 * i * i], i, "a") for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    x, n, s, _ = exact(rows)
    want = {v: sum((n * a - t) ** 2 for a, t in zip(row, s, strict=True)) for v, row in x}
    assert {r.vec_id: int(r.deviation_digits) for r in got} == want
    assert all(r.deviation is None for r in got)


@pytest.mark.parametrize("high", [100, 10**6, 2**40, 2**62])
def test_moments_are_exact(high):
    r = np.random.default_rng(3)
    x = r.integers(-high, high, (3000, 5), dtype=np.int64)
    m = whitening.Moments(5)
    for part in np.array_split(x, 7):
        m.add(part)
    rows = {(p, q): (int(h) << 60) + int(low) for p, q, h, low in m.rows()}
    plain = x.astype(object)
    assert rows[-1, -1] == 3000
    for p in range(5):
        assert rows[p, -1] == sum(plain[:, p])
        for q in range(p, 5):
            assert rows[p, q] == sum(plain[:, p] * plain[:, q])


def test_eigenvectors_of_scattered_values():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(20, 20)))
    want = 10.0 ** -np.arange(20)
    q = q.astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(20) - q.T @ q) / 2
    value, axes = whitening.eigen((q * want) @ q.T)
    assert np.abs(value[:13].astype(float) / want[:13] - 1).max() < 1e-5
    assert np.abs((axes.T @ axes - np.eye(20)).astype(float)).max() < 1e-14
