"""Exact top-k search by inner product: sorted lists read in order, with bounds and no random access.

The index is a Parquet table of blocks of at most BLOCK_ROWS vectors. A block holds, for every
dimension, the list of its entries sorted by value; a query reads the lists of its positive components
from the top and those of its negative ones from the bottom. What has been read of a vector, with the
list's last value read for the rest, bounds its score from above; with the list's far end, from
below. The lists are read to the same depth for a whole group of queries, so both bounds are products
of the queries with the entries read so far. The k-th best lower bound, or a better one from earlier
blocks, is the bar: a vector whose upper bound is under it is dropped, a query none of whose vectors
is left is done with the block, and reading goes deeper only for the others. The last step has read the vectors that
are left to the end, which resolves their scores; they are whole numbers and exact.

Queries are a stated set against all rows, sent to the tasks in blocks of QUERY_BLOCK_BYTES; a task
returns k rows a query. Index and answers are tables, so a lost executor costs its tasks only.

Defined cases: vectors that are null or hold a null or non-finite component (also one that isn't
finite any more when scaled) take no part; a shorter vector lacks its last components, which add nothing;
an empty vector scores 0 against all; equal scores go by vec_id, rows without one last, then by the row's place in the
input; a query's own row is no candidate, but other rows with its vec_id are; scores beyond a long count as the
nearest long; fewer candidates than k are all returned, none give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LAST_ID, identified, materialise, release, scratch_path, table
from .vectors import finite_rows, widened

SCALE, TOP = 256, 5
BLOCK_ROWS = 2048
#: Vectors of queries sent to the tasks at once, in bytes, and queries answered together within a task.
QUERY_BLOCK_BYTES, GROUP = 8 << 20, 512
#: Shares of the lists after which bounds are compared; the last step resolves what is left.
DEPTHS = (0.0, 0.25, 0.5, 0.6, 0.75)
INDEX = "n int, width int, rows binary, ids binary, values binary, places binary"
_LONG = 2.0**63


def _scaled(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows that take part, their whole-number components (as doubles), their widths."""
    good, x, width = finite_rows(batch.column(2))
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    fine = np.isfinite(x).all(axis=1)
    return good[fine], x[fine], width[fine]


def _source(known: DataFrame) -> DataFrame:
    return known.select("row", F.col("doc.vec_id").cast("long").alias("vec_id"), F.col("doc.embedding").alias("embedding"))


def build_index(known: DataFrame, path: str, scale: int = SCALE) -> DataFrame:
    """Write the sorted lists of all identified() rows (vec_id, embedding) to path and return them."""

    def block(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list:
        order = np.argsort(x, axis=0, kind="stable")
        return [len(x), x.shape[1], rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), np.take_along_axis(x, order, 0).T.astype("<f8").tobytes(), order.T.astype("<u2").tobytes()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            width = max(x.shape[1] for _, _, x in held)
            rows, ids, x = np.concatenate([r for r, _, _ in held]), np.concatenate([i for _, i, _ in held]), np.concatenate([widened(x, width) for _, _, x in held])
            got = [block(rows[lo : lo + BLOCK_ROWS], ids[lo : lo + BLOCK_ROWS], x[lo : lo + BLOCK_ROWS]) for lo in range(0, len(x), BLOCK_ROWS)]
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["n", "width", "rows", "ids", "values", "places"])

        for b in it:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                good, x, _ = _scaled(part, scale)
                ids = part.column(1).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
                if len(good):
                    held.append((part.column(0).to_numpy()[good], ids[good], x))
                    n += len(good)
                if n >= BLOCK_ROWS:
                    yield flush()
        if held:
            yield flush()
        release()

    spark = known.sparkSession
    _source(known).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Block:
    """One row of the index: per dimension the sorted values and the places of their vectors."""

    def __init__(self, n: int, width: int, rows: bytes, ids: bytes, values: bytes, places: bytes):
        self.n, self.width = n, width
        self.rows, self.ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.values = np.frombuffer(values, "<f8").reshape(width, n)
        self.places = np.frombuffer(places, "<u2").reshape(width, n)
        self.least, self.most = (self.values[:, 0], self.values[:, -1]) if n and width else (np.zeros(width), np.zeros(width))

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """The entries read from the top and from the bottom; the rest by each list's last value read, and by its far end."""
        top_high, bottom_low = np.empty((self.n, self.width)), np.empty((self.n, self.width))
        top_low, bottom_high = np.empty_like(top_high), np.empty_like(bottom_low)
        cut = max(depth, 1)
        top_high[:], top_low[:] = self.values[:, self.n - cut], self.least
        bottom_low[:], bottom_high[:] = self.values[:, cut - 1], self.most
        if depth:
            dims = np.broadcast_to(np.arange(self.width)[:, None], (self.width, depth))
            last, first = (self.places[:, self.n - depth :], dims), (self.places[:, :depth], dims)
            top_high[last] = top_low[last] = self.values[:, self.n - depth :]
            bottom_low[first] = bottom_high[first] = self.values[:, :depth]
        elif self.n:
            top_high[:], bottom_low[:] = self.most, self.least
        return top_high, top_low, bottom_low, bottom_high


class Best:
    """The k best rows of each query so far: scores, vec_ids and rows, best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = (np.zeros((n, 0), np.int64) for _ in range(3))

    def bar(self, q: slice) -> np.ndarray:
        full = self.score.shape[1] == self.k
        return self.score[q, -1].astype(float) if full else np.full(len(self.score[q]), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows of (query number, score, id, row), several a query."""
        if not len(query):
            return
        order = np.lexsort((rows, ids, ~score, query))  # ~score falls as score rises, without overflow
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        take = place < self.k
        query, place, score, ids, rows = query[take], place[take], score[take], ids[take], rows[take]
        touched, at = np.unique(query, return_inverse=True)
        new = [np.full((len(touched), self.k), fill, np.int64) for fill in (-(2**63), LAST_ID, LAST_ID)]
        for m, v in zip(new, (score, ids, rows), strict=True):
            m[at, place] = v
        old = [np.pad(m, ((0, 0), (0, self.k - m.shape[1])), constant_values=fill) for m, fill in ((self.score, -(2**63)), (self.id, LAST_ID), (self.row, LAST_ID))]
        s, i, r = (np.concatenate([o[touched], m], axis=1) for o, m in zip(old, new, strict=True))
        by = np.lexsort((r, i, ~s), axis=1)[:, : self.k]
        for m, v in zip(old, (s, i, r), strict=True):
            m[touched] = np.take_along_axis(v, by, 1)
        self.score, self.id, self.row = old


def _whole(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, exactly: as integers of any length, cut to a long."""
    out = [max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(x.tolist(), q.tolist(), strict=True)]
    return np.array(out, np.int64)


def search_block(block: Block, q: np.ndarray, own: np.ndarray, bar: np.ndarray, k: int, counts: dict | None = None):
    """(query number, place) pairs of a block that may be among a query's k best, with their exact scores.

    q: queries x dimensions; own: each query's row; bar: a score that k vectors elsewhere reach (or -inf).
    counts, if given, adds up entries read and scores resolved, for tests.
    """
    width = min(q.shape[1], block.width)
    asked = np.arange(len(q))
    alive = np.ones((len(q), block.n), bool)
    where = {int(r): i for i, r in enumerate(block.rows)}
    for j, r in enumerate(own.tolist()):
        if r in where:
            alive[j, where[r]] = False
    bar = bar.copy()
    left = np.arange(block.n)
    plus, minus = np.maximum(q[:, :width], 0), np.minimum(q[:, :width], 0)
    reach = np.maximum(np.abs(block.least), np.abs(block.most))[:width]
    with np.errstate(over="ignore", invalid="ignore"):
        limit = float((np.abs(q[:, :width]) @ reach).max(initial=0)) if width else 0.0
    exact = limit < 2.0**53
    slack = 0.0 if exact else limit * (width + 4) * 2.0**-51
    if width and np.isfinite(limit * 4):
        for share in DEPTHS:
            depth = int(share * block.n)
            if share and not depth:
                continue
            seen = block.read(depth)
            top_high, top_low, bottom_low, bottom_high = (m[left, :width] for m in seen)
            upper = plus[asked] @ top_high.T + minus[asked] @ bottom_low.T + slack
            here = alive[np.ix_(asked, left)]
            if depth:
                lower = plus[asked] @ top_low.T + minus[asked] @ bottom_high.T - slack
                lower[~here] = -np.inf
                if lower.shape[1] >= k:
                    own_bar = np.clip(np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k], None, _LONG)
                    bar[asked] = np.maximum(bar[asked], np.where(own_bar <= -_LONG, -np.inf, own_bar))
            here &= np.maximum(upper, -_LONG) >= bar[asked, None]
            alive[np.ix_(asked, left)] = here
            if counts is not None:
                counts["read"] = counts.get("read", 0) + len(asked) * len(left)
            asked, left = asked[here.any(axis=1)], left[here.any(axis=0)]
            if not len(asked):
                break
            if here.sum() * 16 < here.size:  # few pairs are left: resolve them
                break
    j, i = np.nonzero(alive[np.ix_(asked, left)])
    j, i = asked[j], left[i]
    if counts is not None:
        counts["resolved"] = counts.get("resolved", 0) + len(j)
    if not len(j):
        return j, i, np.zeros(0, np.int64)
    rest = np.zeros((block.n, block.width))
    rest[block.places, np.arange(block.width)[:, None]] = block.values  # the lists to their ends
    score = np.empty(len(j), np.int64)
    for lo in range(0, len(j), 1 << 16):
        a, b = rest[i[lo : lo + (1 << 16)], :width], q[j[lo : lo + (1 << 16)], :width]
        score[lo : lo + (1 << 16)] = np.einsum("nd,nd->n", a, b).astype(np.int64) if exact else _whole(a, b)
    return j, i, score


def _answer(index: DataFrame, rows: list[int], q: np.ndarray, k: int, path: str) -> None:
    """Append the k best rows of each query in each task to path."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((np.array(rows, np.int64), q))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        best = Best(len(q), k)
        for b in it:
            for i in range(b.num_rows):
                block = Block(*(b.column(c)[i].as_py() for c in range(6)))
                for lo in range(0, len(q), GROUP):
                    part = slice(lo, min(lo + GROUP, len(q)))
                    j, at, score = search_block(block, q[part], own[part], best.bar(part), k)
                    best.add(j + lo, score, block.ids[at], block.rows[at])
        query, place = np.nonzero(best.row < LAST_ID)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[query], best.score[query, place], best.id[query, place], best.row[query, place])], ["query_row", "score", "vec_id", "row"])
        release()

    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = conf.get(name)
    conf.set(name, "4")  # a row is a block
    try:
        index.mapInArrow(run, "query_row long, score long, vec_id long, row long").write.mode("append").parquet(path)
    finally:
        conf.set(name, old)
        sent.destroy()


def exact_top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query; queries is a condition on vec_id and other columns of vectors."""
    spark = vectors.sparkSession
    known = identified(vectors.select("vec_id", "embedding"))
    index = build_index(known, scratch_path(spark, "sorted-lists"), scale)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            good, x, width = _scaled(b, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good)), pa.array([v[:w].tobytes() for v, w in zip(x, width, strict=True)], pa.binary())], ["row", "vec_id", "x"])

    asked = materialise(_source(known).where(queries).mapInArrow(run, "row long, vec_id long, x binary"), "queries")
    path = scratch_path(spark, "answers")
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def send() -> None:
        width = max(len(v) for _, v in held)
        _answer(index, [r for r, _ in held], np.array([np.pad(v, (0, width - len(v))) for _, v in held]).reshape(len(held), width), k, path)

    spark.createDataFrame([], "query_row long, score long, vec_id long, row long").write.parquet(path)
    for r in asked.toLocalIterator():
        held.append((r.row, np.frombuffer(bytes(r.x), "<f8")))
        size = max(size, len(r.x))
        if (len(held) + 1) * max(size, 64) > QUERY_BLOCK_BYTES:
            send()
            held, size = [], 0
    if held:
        send()
    found = spark.read.schema("query_row long, score long, vec_id long, row long").parquet(path)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ids = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query_row").select("query_id", "rank", F.nullif("vec_id", F.lit(LAST_ID)).alias("vec_id"), "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op11_exact_top_k": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
