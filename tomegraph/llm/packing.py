"""Best-fit packing of token documents into sequences, with certified bin counts.

Each partition packs its pieces by best-fit decreasing and takes a lower bound on its number of
sequences from dual-feasible functions. Where the two agree the packing is certified as optimal and
stays, but for a last sequence that is far from full. Partitions with a gap give all their unfilled
sequences back. What is given back is dealt anew and packed again, until nothing is given back, one
partition holds it all, or a round saves no sequence.

Defined cases: null text is empty text, whose only id is the end id; documents longer than the
capacity are cut into full pieces and a rest; equal doc_ids keep a row each; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, slices, table
from .tokens import encoder, vocabulary

#: Pieces that one partition packs; a fixed amount, so a task's memory doesn't grow with the input.
PARTITION_PIECES = 200_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 of every document's pieces of at most `capacity` ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for b in slices(it, keep="encoder"):
            cols: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.many(b.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = np.ascontiguousarray(ids[at : at + capacity], "<u4")
                    for c, x in zip(cols, (doc_id, k, at, len(part), zlib.crc32(part)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and the filling of each bin.

    Bins are kept by free space and a bit set tells which spaces occur, so the tightest bin that
    fits is found without a search over bins.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    present = 0  # bit r: some bin has r free ids
    filled: list[int] = []
    sizes = lengths.tolist()
    for i in order.tolist():
        n = sizes[i]
        fits = present >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            stack = free[r]
            b = stack.pop()
            if not stack:
                present &= ~(1 << r)
        else:
            r, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if r > n:
            free.setdefault(r - n, []).append(b)
            present |= 1 << (r - n)
    return bins, offsets, np.array(filled, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions and the plain volume.

    With `times`, lengths are distinct and occur so often.
    """
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True) if times is None else (lengths, times)
    best = -(-int((size * n).sum()) // capacity)
    # f_e: items over capacity - e count as whole bins, items under e as nothing
    for e in range(1, capacity // 2 + 1):
        big = int(n[size > capacity - e].sum())
        mid = (size >= e) & (size <= capacity - e)
        best = max(best, big + -(-int((size[mid] * n[mid]).sum()) // capacity))
    # u_k: sizes rounded to multiples of 1/k, exact multiples of capacity/(k+1) left as they are
    for k in range(1, 21):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best


def total_bound(items: DataFrame, capacity: int) -> int:
    """lower_bound() of all items at once; the driver sees at most `capacity` lengths and their numbers."""
    rows = items.groupBy("length").agg(F.count("*").alias("n")).collect()
    return lower_bound(np.array([r.length for r in rows], np.int64), capacity, np.array([r.n for r in rows], np.int64))


def _pack(items: DataFrame, partitions: int, capacity: int, round_no: int) -> DataFrame:
    """One round: deal, pack, certify. Adds sequence_id, offset, filled, certified."""
    dealt = items.repartition(partitions, F.xxhash64("doc_id", "piece", "uid", F.lit(round_no)))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, filled long, certified boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        lengths = t.column("length").to_numpy().astype(np.int64)
        bins, offsets, filled = best_fit_decreasing(lengths, capacity)
        ok = len(filled) == lower_bound(lengths, capacity)
        first = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        t = t.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets)).append_column("filled", pa.array(filled[bins])).append_column("certified", pa.array(np.full(len(bins), ok)))
        yield from t.to_batches(max_chunksize=50_000)

    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "uid").mapInArrow(run, fields)


def pack(items: DataFrame, capacity: int, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    left = materialise(items.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = [left.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("uid"), "offset": F.lit(0).cast("long")})]
    left = left.where(F.col("length") < capacity)
    round_no, pooled = 1, None
    while n := left.count():
        partitions = max(1, -(-n // partition_pieces))
        packed = materialise(_pack(left, partitions, capacity, round_no), "packed")
        bins = packed.select("sequence_id").distinct().count()
        # a certified partition gives back only what is far from full: its last sequence
        given = (F.col("filled") < capacity) & (~F.col("certified") | (4 * F.col("filled") < 3 * capacity))
        pool = packed.where(given)
        next_pooled = pool.select("sequence_id").distinct().count()
        if partitions == 1 or next_pooled <= 1 or (pooled is not None and bins >= pooled):
            done.append(packed)
            break
        done.append(packed.where(~given))
        left, pooled = pool.select("doc_id", "piece", "start", "length", "ids_crc32", "uid"), next_pooled
        round_no += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = done[0].select(cols)
    for d in done[1:]:
        out = out.unionByName(d.select(cols))
    return out


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, capacity=4096), 4096)


ORACLE: dict[str, str] = {}
