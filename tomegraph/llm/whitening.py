"""Embedding whitening from exact integer moments: digit-slice products in BLAS, big-integer merges.

Each entry c becomes the whole number floor(SCALE * c) + SHIFT. A task cuts its numbers into limbs of LIMB_BITS
bits (the highest one signed), multiplies limb matrices as float64, where every sum of a product stays below
2**53 and is exact, and puts limbs together as big integers. Spark adds the moments of all tasks,
entry by entry, each as two decimals, so they stay exact at any number of rows. The covariance
(n M - S S') / n**2 is formed from them without cancellation; LAPACK gives its eigenvectors, and their
quotients in extended precision the eigenvalues. A second pass centres and projects the rows; a third, over what was written, measures the whitened
covariance. The driver gets width**2 numbers, whatever the table's length.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped; a shorter vector
counts as filled with zeros up to the longest; numbers beyond +-2**62 count as that; components whose
eigenvalue is at most RANK_TOL of the trace can't be scaled to one and are left out, so a table of one
row or of equal rows gives none; equal vec_ids and repeated rows count and keep rows of their own; a
deviation beyond a long is null, its digits stand in deviation_digits; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, scratch_path, table
from .vectors import finite_rows, widened

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMB_BITS = 16
#: Rows of a BLAS product: 2**(2 * LIMB_BITS) * SLICE_ROWS < 2**53.
SLICE_ROWS = 1 << 14
RANK_TOL = 1e-12
_LOW_BITS = 60
_CUT = 1 << 62
MOMENTS = "p int, q int, high decimal(38,0), low decimal(38,0)"


def whole_numbers(x: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * x) + shift as int64, within +-2**62."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    wide = np.abs(scaled) >= float(_CUT)
    out = np.clip(np.where(wide, 0, scaled).astype(np.int64) + shift, -_CUT, _CUT)
    return np.where(wide, np.where(scaled > 0, _CUT, -_CUT), out) if wide.any() else out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb[i] * 2**(LIMB_BITS * i); all but the last are in [0, 2**LIMB_BITS), the last is signed."""
    out = []
    while x.size and (x.min() < -(1 << (LIMB_BITS - 1)) or x.max() >= 1 << LIMB_BITS):
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS
    return [*out, x.astype(np.float64)]


class Moments:
    """Count, sums and sums of products of int64 rows, exact."""

    def __init__(self, width: int = 0):
        self.n, self.width = 0, width
        self.sums = np.zeros(width, object)
        self.products = np.zeros((width, width), object)
        self.held: dict[int, np.ndarray] = {}  # products by the place of their limbs, as int64
        self.held_rows = 0

    def add(self, x: np.ndarray) -> None:
        if x.shape[1] > self.width:
            raise ValueError("rows are wider than the moments")
        for lo in range(0, len(x), SLICE_ROWS):
            part = x[lo : lo + SLICE_ROWS]
            cut = limbs(part)
            for a, left in enumerate(cut):
                self.sums += left.sum(axis=0).astype(np.int64).astype(object) << (LIMB_BITS * a)
                for b in range(a, len(cut)):
                    product = left.T @ cut[b]
                    if b > a:
                        product += product.T.copy()
                    self.held.setdefault(a + b, np.zeros((self.width, self.width), np.int64)).__iadd__(product.astype(np.int64))
            self.n += len(part)
            self.held_rows += len(part)
            if self.held_rows > 1 << 24:  # below 2**62 in all held sums
                self._recombine()

    def _recombine(self) -> None:
        for place, product in self.held.items():
            self.products += product.astype(object) << (LIMB_BITS * place)
        self.held, self.held_rows = {}, 0

    def rows(self) -> list[tuple[int, int, Decimal, Decimal]]:
        """(p, q, high, low) with value = high * 2**60 + low; p = -1: the count; q = -1: the sums; else p <= q."""
        self._recombine()
        cut = lambda v: (Decimal(v >> _LOW_BITS), Decimal(v & ((1 << _LOW_BITS) - 1)))
        out = [(-1, -1, *cut(self.n))]
        for p in range(self.width):
            out.append((p, -1, *cut(int(self.sums[p]))))
            out += [(p, q, *cut(int(self.products[p, q]))) for q in range(p, self.width)]
        return out


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))


def width_of(df: DataFrame) -> int:
    """Length of the longest vector that takes part."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([int(finite_rows(b.column(1))[2].max(initial=0))])], ["width"])

    longest = _vectors(df).where(F.col("embedding").isNotNull()).agg(F.max(F.size("embedding"))).first()[0] or 0
    usual = _vectors(df).where(F.size("embedding") == longest)
    # only if every longest vector is unusable does the rest decide
    if not longest or usual.where(~F.exists("embedding", _unusable)).limit(1).count():
        return longest
    return _vectors(df).mapInArrow(run, "width long").agg(F.max("width")).first()[0] or 0


def _unusable(c):
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))


def moments(df: DataFrame, width: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S (width) and M (width x width) of all rows that take part, as Python integers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(width)
        for b in it:
            _, x, _ = finite_rows(b.column(1))
            if len(x):
                total.add(whole_numbers(widened(x, width), scale, shift))
        if total.n:
            got = list(zip(*total.rows(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.decimal128(38, 0)), pa.array(got[3], pa.decimal128(38, 0))], ["p", "q", "high", "low"])

    parts = _vectors(df).mapInArrow(run, MOMENTS).groupBy("p", "q").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    n, s, m = 0, np.zeros(width, object), np.zeros((width, width), object)
    for r in materialise(parts, "moments").toLocalIterator():
        v = (int(r.high) << _LOW_BITS) + int(r.low)
        if r.p < 0:
            n = v
        elif r.q < 0:
            s[r.p] = v
        else:
            m[r.p, r.q] = m[r.q, r.p] = v
    return n, s, m


def covariance(n: int, s: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(n M - S S') / n**2 from exact numerators, in extended precision."""
    top = n * m - np.outer(s, s)
    den = np.longdouble(n) * np.longdouble(n)
    return np.array([[np.longdouble(str(v)) / den for v in row] for row in top.tolist()], np.longdouble).reshape(top.shape)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; the values as quotients in v's own precision."""
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x.astype(np.longdouble)
    value = np.diag(x.T @ v @ x) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits for every row that takes part and component."""
    spark = vectors.sparkSession
    width = width_of(vectors)
    n, s, m = moments(vectors, width, scale, shift)
    v = covariance(n, s, m) if n and width else np.zeros((0, 0), np.longdouble)
    value, axes = eigen(v) if n and width else (np.zeros(0), v)
    trace = np.trace(v) if n and width else 0
    kept = int(np.count_nonzero(value[:components] > RANK_TOL * trace)) if n else 0
    projection = (axes[:, :kept] / np.sqrt(value[:kept])).astype(np.float64)
    centre = np.array([int(t) // n for t in s], np.int64) if n else np.zeros(width, np.int64)
    rest = [int(t) % n for t in s] if n else []
    model = spark.sparkContext.broadcast((n, width, centre, rest, projection))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width, centre, rest, projection = model.value
        share = np.array([r / n for r in rest])
        for b in it:
            good, x, _ = finite_rows(b.column(1))
            if not len(good) or not projection.shape[1]:
                continue
            off = whole_numbers(widened(x, width), scale, shift) - centre  # both within 2**62, so no overflow
            out = (off.astype(np.float64) - share) @ projection
            if (n * (int(np.abs(off).max()) + 1)) ** 2 * width < 1 << 62:
                deviation = [int(d) for d in ((n * off - np.array(rest, np.int64)) ** 2).sum(axis=1)]
            else:
                deviation = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in off.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(good)), pa.array([str(d) for d in deviation]), pa.array(list(out), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"]
            )
        release()

    rows = _vectors(vectors).mapInArrow(run, "vec_id long, deviation string, w array<double>")
    path = scratch_path(spark, "whitened")
    rows.write.parquet(path)
    rows = spark.read.schema("vec_id long, deviation string, w array<double>").parquet(path)
    error = identity_error(rows, n, kept)
    share = F.array(*(F.lit(float(e / trace)) for e in value[:kept])) if kept else F.array(F.lit(0.0))
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.col("deviation").alias("deviation_digits"),
    )


def identity_error(rows: DataFrame, n: int, kept: int) -> float | None:
    """Largest absolute entry of the covariance of w over all rows minus the identity, measured."""
    if not kept:
        return None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept + 1))
        for b in it:
            w = b.column(0).values.slice(b.column(0).offsets[0].as_py(), b.num_rows * kept).to_numpy().reshape(-1, kept)
            total[:, :kept] += w.T @ w
            total[:, kept] += w.sum(axis=0)
        p, q = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(p.ravel()), pa.array(q.ravel()), pa.array(total.ravel())], ["p", "q", "v"])

    got = np.zeros((kept, kept + 1))
    for r in rows.select("w").mapInArrow(run, "p long, q long, v double").groupBy("p", "q").agg(F.sum("v").alias("v")).toLocalIterator():
        got[r.p, r.q] = r.v / n
    mean = got[:, kept]
    return float(np.abs(got[:, :kept] - np.outer(mean, mean) - np.eye(kept)).max())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


ORACLE: dict[str, str] = {}
