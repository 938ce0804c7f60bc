"""Embeddings and similarity search (GRA-7, GRA-8, WIN-6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import cosine


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words, normalised; deterministic and offline. The first 32 bits of a word's MD5 give slot and sign."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
                out[i, h % self.width] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(df: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """df with an array<float> of its text, in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.embed(s.fillna("").tolist())))

    return df.withColumn(column, run(F.col(text)))


def top_k(vectors: DataFrame, query: list[float], k: int = 3, ord: str = "ord") -> DataFrame:
    """The k rows closest to the query, score rounded to 6 places; equal scores go by ord, the last first."""
    score = F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 6)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), F.desc(ord)).limit(k)


class Best:
    """The k best rows of each of n queries so far, by score and then id, the last first; rows below a query's k-th are not held.

    What is held is sorted whenever FRESH new rows have come, so it is bounded by n x k and not by the rows seen.
    """

    #: New rows held at most before they are settled, and scores worked out at a time.
    FRESH, SCORES = 1 << 18, 1 << 20

    def __init__(self, n: int, k: int):
        self.k, self.least, self.fresh = k, np.full(n, -np.inf), 0
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def step(self, rows: int) -> int:
        """Queries that are scored against so many rows at a time."""
        return max(1, self.SCORES // max(1, rows))

    def add(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores, queries x ids; own: the queries' ids, which are no candidates."""
        bar = self.least[queries]
        if len(ids) > self.k:
            # of rows that tie with the last of the k any may be wanted
            bar = np.fmax(bar, np.partition(np.where(own[:, None] == ids[None, :], -np.inf, score), len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        j, i = np.nonzero(~(score < bar[:, None]) & (own[:, None] != ids[None, :]))
        self.held.append((queries[j], ids[i], score[j, i]))
        self.fresh += len(j)
        if self.fresh >= self.FRESH:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of what is held."""
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        take = place < self.k
        self.held, self.fresh = [(query[take], ids[take], score[take])], 0
        return self.held[0]


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int = 3, block: int = 512) -> DataFrame:
    """query_id, id, rank, score of the k closest rows (id, embedding) of each query (query_id, embedding).

    Queries come in blocks that fit a task; each task keeps k rows a query from its vectors, whatever
    their number, so only queries x tasks x k rows are shuffled.
    """
    spark = vectors.sparkSession
    out = None
    held: list[tuple[int, list[float]]] = []

    def answer(part):
        ids = np.array([i for i, _ in part], np.int64)
        q = np.array([v for _, v in part], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((ids, q))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(len(ids), k)
            for b in it:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    step = best.step(len(x))
                    for at in range(0, len(ids), step):
                        here = np.arange(at, min(len(ids), at + step))
                        best.add(here, ids[here], part.column(0).to_numpy(), np.round(q[here] @ x.T, 6))
            j, row, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(row), pa.array(score)], ["query_id", "id", "score"])

        rows = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
        return rows.mapInArrow(run, "query_id long, id long, score double")

    for r in queries.select("query_id", "embedding").toLocalIterator():
        held.append((r.query_id, list(r.embedding)))
        if len(held) == block:
            out = answer(held) if out is None else out.unionByName(answer(held))
            held = []
    if held or out is None:
        part = answer(held) if held else spark.createDataFrame([], "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    return out.where("id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
