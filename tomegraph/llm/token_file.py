"""Token-id output as independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers:

    data frames        FRAME_TOKENS ids each (the last one fewer), independent zstd frames
    document frame     skippable frame: doc_id int64 and token count uint64 of each document, zstd
    seek frame         skippable frame: per data frame compressed size, plain size, checksum
                       (low 32 bits of XXH64), all uint32; then frame count, flags, magic

The seek frame is that of the public seekable zstd format, so its readers can open the data part. A
reader fetches the two tables, then only the frames that hold the ids asked for.

A task closes its file at FILE_TOKENS ids or FILE_DOCS documents and starts another, so a file's two tables stay small
and fit into memory; a document is never cut.

Files are named by task attempt and become visible only through the manifest, the Parquet table
which Spark's committer writes from the attempts that succeeded; leftovers of lost tasks are never read.

Defined cases: null text is empty text, a document without ids still has its end id; null doc_ids come first; equal doc_ids
keep a record each (equal rows in any order); an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, identified, materialise, row_text, scratch_path, shuffle_partitions, slices, table
from .tokens import encoder, vocabulary

FRAME_TOKENS = 1 << 15
SEEK_MAGIC, SKIP_SEEK, SKIP_DOCS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
#: A file is closed once it holds that many ids or documents: its tables stay small, whatever a task writes.
FILE_TOKENS, FILE_DOCS = 1 << 26, 1 << 20
#: Bytes of text aimed at for a task.
TASK_BYTES = 512 << 20


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to a binary sink, one data frame in memory."""

    def __init__(self, sink, level: int = 1):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.docs: list[tuple[int, int]] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= FRAME_TOKENS:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        cut = len(ids) if end else len(ids) - len(ids) % FRAME_TOKENS
        for i in range(0, cut, FRAME_TOKENS):
            raw = ids[i : min(i + FRAME_TOKENS, cut)].astype("<u4").tobytes()
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), _checksum(raw)))
        self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        plain = np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        packed = self.zstd.compress(plain)
        body = packed + struct.pack("<QIQ", len(self.docs), _checksum(plain), len(packed))
        self.sink.write(struct.pack("<II", SKIP_DOCS, len(body)) + body)
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


class Reader:
    """Random access to one file; source has seek() and read()."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(n, 3)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4, dtype=np.int64)])
        end = begin - 8
        n_docs, want, packed = struct.unpack("<QIQ", self._at(end - 20, 20))
        plain = self.zstd.decompress(self._at(end - 20 - packed, packed), max_output_size=16 * n_docs) if n_docs else b""
        if _checksum(plain) != want:
            raise ValueError("document table: checksum differs")
        self.doc_ids = np.frombuffer(plain, "<i8", n_docs)
        self.counts = np.frombuffer(plain, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))
        self.decoded = 0

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            raw = self.zstd.decompress(self._at(int(self.places[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if _checksum(raw) != int(self.frames[k, 2]):
                raise ValueError(f"frame {k}: checksum differs")
            self._held = (k, np.frombuffer(raw, "<u4"))
            self.decoded += 1
        return self._held[1]

    def pieces(self, i: int) -> Iterator[np.ndarray]:
        """The ids of the file's i-th document, frame by frame."""
        at, end = int(self.starts[i]), int(self.starts[i + 1])
        k = int(np.searchsorted(self.first, at, "right")) - 1
        while at < end:
            ids, base = self.frame(k), int(self.first[k])
            stop = min(end, base + len(ids))
            yield ids[at - base : stop - base]
            at, k = stop, k + 1

    def ids(self, i: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.pieces(i)])


def _fs(path: str):
    """File system and place of a URI, by Arrow: local folders, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None, file_tokens: int = FILE_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest (part, seq, path, n_docs, n_tokens), a row a file."""
    spark = docs.sparkSession
    ordered = row_text(identified(docs.select("doc_id", "text"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", "row")
    if not partitions:
        size = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(shuffle_partitions(spark), -(-size // TASK_BYTES))
    # rows of one id, or without one, may reach over several files, in the order of their places
    ordered = ordered.repartitionByRange(partitions, "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        part, seq = TaskContext.get().partitionId(), 0
        out = sink = fs = place = None

        def closed() -> pa.RecordBatch:
            nonlocal out, seq
            out.close()
            sink.close()
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{place.rpartition('/')[2]}"], "n_docs": [len(out.docs)], "n_tokens": [out.n_tokens]}
            out, seq = None, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for b in slices(it, keep="encoder"):
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.many(b.column(1).to_pylist()), strict=True):
                if out is None:
                    fs, place = _fs(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst")
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(place, compression=None)
                    out = Writer(sink)
                out.add(doc_id, np.append(ids, end))
                if out.n_tokens >= file_tokens or len(out.docs) >= file_docs:
                    yield closed()
        if out is not None:
            yield closed()

    return materialise(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # one row per file: small, and the place of a file in the whole needs those before it
    base, rows = 0, []
    for r in manifest.orderBy("part", "seq").toLocalIterator():
        rows.append((r.path, base))
        base += r.n_tokens
    held = pa.table({"path": pa.array([p for p, _ in rows], pa.string()), "base": pa.array([b for _, b in rows], pa.int64())})
    files = spark.createDataFrame(held).repartition(max(1, len(rows)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, place = _fs(path)
                with fs.open_input_file(place) as source:
                    r = Reader(source, source.size())
                    for lo in range(0, len(r.doc_ids), 10_000):
                        hi = min(lo + 10_000, len(r.doc_ids))
                        crc = []
                        for i in range(lo, hi):
                            c = 0
                            for ids in r.pieces(i):
                                c = zlib.crc32(ids, c)
                            crc.append(c)
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[lo:hi]), pa.array(first + r.starts[lo:hi]), pa.array(r.counts[lo:hi]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def fetch(manifest: DataFrame, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of the requested documents of one file; only their frames are decompressed."""
    fs, place = _fs(path)
    with fs.open_input_file(place) as source:
        r = Reader(source, source.size())
        at = {int(d): i for i, d in enumerate(r.doc_ids)}
        return {d: r.ids(at[d]).tolist() for d in doc_ids if d in at}


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), vocabulary(), end_id=2)
    return read(manifest)


ORACLE: dict[str, str] = {}
