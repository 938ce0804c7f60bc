"""A persisted vector index: inverted lists with residual codes, re-ranked exactly (GRA-7, GRA-8, WIN-6).

Directions are parted into cells by k-means, and what a vector differs from its cell's centre by is coded
by one byte for each of up to 16 groups of dimensions. Centres and codes are fitted on at most
SAMPLE_ROWS vectors (those with the smallest hash of their id); every vector is then assigned. The
index is one folder: `model` (one row), `cells` (size and widest angle of each) and `lists`,
partitioned by cell, so that a search reads only the cells it looks into, and of those the codes
alone. The best candidates are scored on their whole vectors, which are read for them only.

The number of cells that a query looks into is set when the index is built: on the sample, so many
that TARGET of the true neighbours are in them. exact=True returns the true neighbours: after the
search above, cells whose widest angle allows a better score than the k-th found are scored whole.

Queries are a stated set and go to the tasks in blocks of BLOCK_BYTES; tasks keep a bounded number of
rows a query. Defined cases: null vectors are not indexed and ask nothing; a zero vector scores 0
against all; scores are cosines rounded to 6 places, equal ones go by id, the last first; a row with the
query's id is no candidate; an empty table makes an index without cells, which answers with no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import BROADCAST_BYTES, materialise, scratch_root
from .search import Best

SAMPLE_ROWS, TARGET = 20_000, 0.97
GROUPS, WORDS = 16, 256
#: Candidates a query that are scored on their whole vectors, for each row asked for.
RERANK = 20
BLOCK_BYTES = 8 << 20
#: Parts that a cell's rows are dealt into when they are written, so that no cell is one task.
SALTS = 16
LISTS = "id long, code binary, embedding array<float>, cell int"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of one width as rows (double)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if width is None and len(column) else width or 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, spherical: bool = False) -> np.ndarray:
    """k centres; those that lose all their rows start again at the rows farthest from their own."""
    r = np.random.default_rng(11)
    centre = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centre))
        centre = total / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        centre[lost] = x[np.argsort(-far)[: len(lost)]]
        if spherical:
            centre = unit(centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and squared distance, in slices."""
    own, distance = np.empty(len(x), np.int64), np.empty(len(x))
    square = (centre**2).sum(axis=1)
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        d = square - 2 * part @ centre.T
        own[lo : lo + len(part)] = d.argmin(axis=1)
        distance[lo : lo + len(part)] = d.min(axis=1) + (part**2).sum(axis=1)
    return own, distance


class Model:
    """Centres of the cells, code words of the groups of dimensions, and how many cells a query looks into."""

    def __init__(self, width: int, centres: np.ndarray, words: np.ndarray, probes: int):
        self.width, self.centres, self.words, self.probes = width, centres, words, probes
        self.step = words.shape[2] if words.size else 0

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, k: int = 10) -> Model:
        x = unit(sample)
        if not x.size:
            return cls(sample.shape[1] if sample.ndim == 2 else 0, np.zeros((0, 0)), np.zeros((0, 0, 0)), 0)
        centres = k_means(x, cells, spherical=True)
        groups = min(GROUPS, x.shape[1])
        step = -(-x.shape[1] // groups)
        groups = -(-x.shape[1] // step)
        own = nearest(x, centres)[0]
        rest = np.pad(x - centres[own], ((0, 0), (0, groups * step - x.shape[1])))
        n_words = min(WORDS, len(x))
        words = np.array([k_means(rest[:, g * step : (g + 1) * step], n_words, rounds=8) for g in range(groups)])
        asked = x[:: max(1, len(x) // 200)]
        best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : k + 1]
        order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # place of each cell in a query's order
        places = np.sort(np.take_along_axis(order, own[best], 1).ravel())
        return cls(x.shape[1], centres, words, int(places[min(len(places) - 1, int(TARGET * len(places)))]) + 1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and angle to the centre of unit vectors."""
        own, _ = nearest(x, self.centres)
        rest = np.pad(x - self.centres[own], ((0, 0), (0, len(self.words) * self.step - self.width)))
        codes = np.stack([nearest(rest[:, g * self.step : (g + 1) * self.step], w)[0] for g, w in enumerate(self.words)], axis=1).astype(np.uint8)
        return own, codes, np.arccos(np.clip((x * self.centres[own]).sum(axis=1), -1, 1))

    def rough(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Scores of the coded vectors of a cell, queries x rows."""
        wide = np.pad(q, ((0, 0), (0, len(self.words) * self.step - self.width)))
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for g, w in enumerate(self.words):
            out += (wide[:, g * self.step : (g + 1) * self.step] @ w.T)[:, codes[:, g]]
        return out


class VectorIndex:
    """An index that build() wrote; open() reads it in any later session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        r = spark.read.parquet(f"{path}/model").first()
        self.model = Model(r.width, np.array(r.centres).reshape(r.cells, r.width), np.array(r.words).reshape(r.groups, -1, r.step) if r.groups else np.zeros((0, 0, 0)), r.probes)
        #: the widest angle of each cell
        self.angles = np.full(r.cells, -1.0)
        for c in spark.read.schema("cell int, angle double, n long").parquet(f"{path}/cells").toLocalIterator():
            self.angles[c.cell] = c.angle

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Index vectors (id, embedding) under path."""
        spark = vectors.sparkSession
        v = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        picked = v.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().column("embedding").combine_chunks()
        sample = matrix(picked) if len(picked) else np.zeros((0, 0))
        # a cell needs some tens of sample rows for its centre
        wanted = cells or max(1, min(int(v.count() ** 0.5), len(sample) // 32))
        model = Model.fit(sample, wanted)
        row = (model.width, len(model.centres), len(model.words), model.step, model.probes, model.centres.ravel().tolist(), model.words.ravel().tolist())
        spark.createDataFrame([row], "width int, cells int, groups int, step int, probes int, centres array<double>, words array<double>").coalesce(1).write.parquet(f"{path}/model")
        sent = spark.sparkContext.broadcast(model)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in it:
                if b.num_rows:
                    cell, codes, angle = m.assign(unit(matrix(b.column(1), m.width)))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "code", "embedding", "cell", "angle"])

        assigned = materialise(v.mapInArrow(run, f"{LISTS}, angle double"), "assigned")
        assigned.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/cells")
        assigned.drop("angle").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).write.partitionBy("cell").parquet(f"{path}/lists")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, id, rank, score of the k rows closest to each query (query_id, embedding)."""
        import uuid

        path = f"{scratch_root(self.spark)}/found-{uuid.uuid4().hex}"
        schema = "query_id long, id long, score double"
        self.spark.createDataFrame([], schema).write.parquet(path)
        held: list[tuple[int, list[float]]] = []
        asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        for r in asked.toLocalIterator() if len(self.model.centres) else ():
            held.append((r.query_id, r.embedding))
            if len(held) * self.model.width * 8 >= BLOCK_BYTES:
                self._answer(held, k, probes or self.model.probes, exact).write.mode("append").parquet(path)
                held = []
        if held:
            self._answer(held, k, probes or self.model.probes, exact).write.mode("append").parquet(path)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
        return self.spark.read.schema(schema).parquet(path).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _answer(self, held: list, k: int, probes: int, exact: bool) -> DataFrame:
        ids, q = np.array([i for i, _ in held], np.int64), unit(np.array([v for _, v in held], np.float64).reshape(len(held), -1))
        toward = q @ self.model.centres.T
        cells = np.argsort(-toward, axis=1, kind="stable")[:, : max(1, probes)]
        wanted = np.zeros(toward.shape, bool)
        np.put_along_axis(wanted, cells, True, 1)
        found = self._scored(self._near(ids, q, wanted, k * RERANK + 1), ids, q, k)
        if not exact:
            return found
        found = materialise(found, "found")
        least = np.full(len(ids), -np.inf)
        at = {int(i): j for j, i in enumerate(ids)}
        for r in found.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k).toLocalIterator():
            least[at[r.query_id]] = r.score
        high = np.cos(np.maximum(0, np.arccos(np.clip(toward, -1, 1)) - self.angles))
        # a zero vector stands at 90 degrees from every centre whatever its query
        rest = (high >= least[:, None] - 2e-6) | ((self.angles >= np.pi / 2 - 1e-9) & (least[:, None] <= 0))
        return self._whole(ids, q, rest & (self.angles >= 0), k)

    def _over_lists(self, column: str, wanted: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, read: Callable, score: Callable) -> DataFrame:
        """query_id, id, score: each task's k best rows a query in the cells that the query wants."""
        sent = self.spark.sparkContext.broadcast((wanted, ids, q, self.model))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, ids, q, model = sent.value
            best = Best(len(ids), k)
            for b in it:
                cell, row = b.column(2).to_numpy(), b.column(0).to_numpy()
                for c in np.unique(cell):
                    asked, here = np.flatnonzero(wanted[:, c]), np.flatnonzero(cell == c)
                    x, step = read(model, b.column(1).take(pa.array(here))), best.step(len(here))
                    for lo in range(0, len(asked), step):
                        part = asked[lo : lo + step]
                        best.add(part, ids[part], row[here], score(model, q[part], int(c), x))
            j, i, s = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(i), pa.array(s)], ["query_id", "id", "score"])

        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        return self.lists.where(F.col("cell").isin(cells)).select("id", column, "cell").mapInArrow(run, "query_id long, id long, score double")

    def _near(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, most: int) -> DataFrame:
        """query_id, id: the candidates by their codes."""

        def read(model: Model, codes: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)

        rows = self._over_lists("code", wanted, ids, q, most, read, Model.rough)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("query_id", "id")

    def _scored(self, near: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        """The k best of the candidates by their whole vectors."""
        near = materialise(near, "near")
        sent = self.spark.sparkContext.broadcast({int(i): v for i, v in zip(ids, q, strict=True)})

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = sent.value
            for b in it:
                if b.num_rows:
                    x = unit(matrix(b.column(2)))
                    s = np.round(np.einsum("nd,nd->n", x, np.array([at[i] for i in b.column(0).to_pylist()])), 6) + 0.0
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["query_id", "id", "score"])

        wanted = near.select("id").distinct()
        wanted = F.broadcast(wanted) if near.count() * 8 <= BROADCAST_BYTES // 4 else wanted
        rows = materialise(self.lists.select("id", "embedding").join(wanted, "id", "left_semi"), "vectors")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
        scored = near.join(rows, "id").select("query_id", "id", "embedding").mapInArrow(run, "query_id long, id long, score double")
        return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

    def _whole(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """Scores on whole vectors of all rows in the cells wanted."""
        return self._over_lists("embedding", wanted, ids, q, k, lambda model, x: unit(matrix(x, model.width)), lambda model, q, cell, x: np.round(q @ x.T, 6) + 0.0)
