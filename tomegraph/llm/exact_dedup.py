"""Exact de-duplication against immutable snapshots screened by static binary-fuse filters.

A snapshot keeps one row per distinct digest, dealt into buckets by the digest, and one filter per
bucket. An incoming batch is first grouped by digest, then its distinct digests pass the filters, a large
batch's share of a bucket in several parts with a copy of the filter each;
only positives join the exact buckets, of which no others are read, and whatever is left is new. An equal digest alone never drops
a row: the bytes of all members are compared, first within each task, so that of a group one body a
task is moved at most; groups whose bytes differ are told apart by their whole texts.

Defined cases: null text is empty text; a row without doc_id is never the one that stays, so a group
of such rows keeps none; empty texts are equal to each other; rows of equal doc_id count as rows of
their own, and of equal rows all that carry the kept doc_id are marked kept; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import BROADCAST_BYTES, identified, materialise, row_text, scratch_path, slices, table

#: Distinct digests aimed at for each bucket of a snapshot, and for each part of a batch that meets a filter.
BUCKET_KEYS = 100_000
#: Folders that a snapshot's buckets are laid in at most.
SHELVES = 4096
_SPACE = b" \t\n\r\x0b\x0c"


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of space, tab, LF, VT, FF, CR replaced by one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() takes exactly these six characters
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1] in _SPACE else b"") + b" ".join(words) + (b" " if raw[-1:] in _SPACE else b"")


def _key(digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8).digest(), "little", signed=True)


def digests(known: DataFrame, batches: int = 2, digest_bytes: int = 32) -> DataFrame:
    """row, doc_id, sha256 (hex), digest (its first digest_bytes), key (uint64 as long), batch (by a hash of row), of identified() rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            full = [hashlib.sha256(normalise(x)).digest() for x in b.column(2).to_pylist()]
            keys = np.array([_key(d[:digest_bytes]) for d in full], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([d.hex() for d in full], pa.string()), pa.array([d[:digest_bytes] for d in full], pa.binary()), pa.array(keys)], ["row", "doc_id", "sha256", "digest", "key"])

    out = row_text(known).mapInArrow(run, "row long, doc_id long, sha256 string, digest binary, key long")
    return out.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))


def _bucket(buckets: int):
    return F.pmod(F.shiftright("key", 7), F.lit(buckets)).cast("int")


class Snapshot:
    """Immutable: groups (shelf, bucket, digest, key, keep_id, n), partitioned by shelf, and filters (bucket, blob), both Parquet in one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    @property
    def groups(self) -> DataFrame:
        return self.spark.read.schema("bucket int, digest binary, key long, keep_id long, n long, shelf int").parquet(f"{self.path}/groups")

    def known(self, passed: DataFrame) -> DataFrame:
        """passed (what screen() let through) joined with its exact groups; only the shelves that it names are read."""
        named = passed.withColumn("bucket", _bucket(self.buckets))
        shelves = [r[0] for r in named.select(F.pmod("bucket", F.lit(SHELVES)).alias("shelf")).distinct().toLocalIterator()]  # SHELVES at most
        return named.join(self.groups.where(F.col("shelf").isin(shelves)).select("bucket", "digest", "keep_id", "n"), ["bucket", "digest"]).drop("bucket")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("bucket int, blob binary").parquet(f"{self.path}/filters")

    @classmethod
    def build(cls, grouped: DataFrame, path: str) -> Snapshot:
        """From groups (digest, key, keep_id, n): deal them into buckets, build the filters."""
        spark = grouped.sparkSession
        buckets = max(1, -(-grouped.count() // BUCKET_KEYS))
        own = cls(spark, path, buckets)
        dealt = grouped.select(_bucket(buckets).alias("bucket"), "digest", "key", "keep_id", "n").withColumn("shelf", F.pmod("bucket", F.lit(SHELVES)))
        dealt.repartition("bucket").write.partitionBy("shelf").parquet(f"{path}/groups")

        def make(key, pdf):
            import pandas as pd

            return pd.DataFrame({"bucket": [int(key[0])], "blob": [fuse.build(pdf["key"].to_numpy(np.int64).view(np.uint64))]})

        # distinct digests are uniform, so a bucket holds about BUCKET_KEYS of them whatever the copies
        own.groups.select("bucket", "key").groupBy("bucket").applyInPandas(make, "bucket int, blob binary").write.parquet(f"{path}/filters")
        return own

    def screen(self, groups: DataFrame) -> DataFrame:
        """groups (digest, key, …) that pass the filter of their bucket: all known digests, few others."""
        parts = self.parts(groups.count())
        dealt = groups.withColumns({"bucket": _bucket(self.buckets), "part": F.pmod(F.shiftright("key", 40), F.lit(parts)).cast("int")})
        copies = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        schema = groups.schema
        names = groups.columns

        def passed(pdf, known):
            import pandas as pd

            if not len(known) or not len(pdf):
                return pd.DataFrame(pdf[names].iloc[:0])
            return pdf[names][fuse.contains(known["blob"].iloc[0], pdf["key"].to_numpy(np.int64).view(np.uint64))]

        return dealt.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInPandas(passed, schema)

    def parts(self, incoming: int) -> int:
        """Into how many parts each bucket's share of a batch is dealt, so that none has many more than BUCKET_KEYS digests."""
        return max(1, -(-incoming // (self.buckets * BUCKET_KEYS)))


def _grouped(rows: DataFrame, keep: str, n: str) -> DataFrame:
    return rows.groupBy("digest", "key").agg(F.min("doc_id").alias(keep), F.count("*").alias(n))


def exact_groups(docs: DataFrame, batches: int = 2, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The first of `batches` slices of the documents becomes the snapshot; each later one is screened
    against it and merged into the next, so the result doesn't depend on the slicing.
    digest_bytes shortens the digest that groups (tests use it to force the byte check to act).
    """
    spark = docs.sparkSession
    known = identified(docs.select("doc_id", "text"))
    rows = materialise(digests(known, batches, digest_bytes), "digests")
    groups = materialise(_grouped(rows.where("batch = 0"), "keep_id", "n"), "groups")
    for step in range(1, batches):
        snapshot = Snapshot.build(groups, scratch_path(spark, "snapshot"))
        incoming = materialise(_grouped(rows.where(F.col("batch") == step), "new_id", "new_n"), "incoming")
        hits = materialise(snapshot.known(materialise(snapshot.screen(incoming), "passed")), "hits")
        fresh = incoming.join(hits.select("digest"), "digest", "left_anti").select("digest", "key", F.col("new_id").alias("keep_id"), F.col("new_n").alias("n"))
        merged = hits.select("digest", "key", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.col("new_n")).alias("n"))
        old = groups.join(hits.select("digest"), "digest", "left_anti")
        groups = materialise(old.unionByName(merged).unionByName(fresh), "groups")
    return _checked(known, rows, groups)


def _checked(known: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their groups; where the bytes of a digest's members differ, its rows are grouped by their texts."""
    shared = groups.where("n > 1").select("digest", "key")
    body = _bodies(known, shared)
    odd = materialise(body.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("digest"), "odd")
    plain = rows.join(groups.select("digest", "keep_id", "n"), "digest")
    if not odd.isEmpty():
        member = rows.join(odd, "digest").select("row", "digest").join(row_text(known), "row").select("row", "doc_id", "digest", "text")

        def bodies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(it):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([normalise(x) for x in b.column(3).to_pylist()], pa.binary())], ["row", "doc_id", "digest", "body"])

        whole = materialise(member.mapInArrow(bodies, "row long, doc_id long, digest binary, body binary"), "odd-texts")
        own = whole.groupBy("digest", "body").agg(F.min("doc_id").alias("keep2"), F.count("*").alias("n2"))
        split = whole.join(own, ["digest", "body"]).select("row", "keep2", "n2")
        plain = plain.join(split, "row", "left")
        plain = plain.withColumns({"keep_id": F.when(F.col("n2").isNull(), F.col("keep_id")).otherwise(F.col("keep2")), "n": F.coalesce("n2", "n")})
    return plain.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha256").alias("text_sha256"))


#: Bytes of bodies that a task remembers, to compare further members with.
HELD_BYTES = 32 << 20


def _bodies(known: DataFrame, shared: DataFrame) -> DataFrame:
    """digest, body of the texts whose digest several rows share, once for each text that a task meets.

    A filter of the shared digests keeps other texts in place; it is sent to the tasks while it stays
    under BROADCAST_BYTES, beyond that the digests are joined instead.
    """
    spark = known.sparkSession
    n = shared.count()
    width = len(shared.select("digest").first()[0]) if n else 32
    blob = None
    if n * 3 < BROADCAST_BYTES // 4:
        keys = np.fromiter((r[0] for r in shared.select("key").toLocalIterator()), np.int64, n) if n else np.zeros(0, np.int64)
        blob = spark.sparkContext.broadcast(fuse.build(keys.view(np.uint64)) if n else b"")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0
        for b in slices(it):
            if blob is not None and not blob.value:
                continue
            bodies = [normalise(x) for x in b.column(0).to_pylist()]
            cut = [hashlib.sha256(x).digest()[:width] for x in bodies]
            take = range(len(cut))
            if blob is not None:
                take = np.flatnonzero(fuse.contains(blob.value, np.array([_key(d) for d in cut], np.int64).view(np.uint64))).tolist()
            out = []
            for i in take:
                if held.get(cut[i]) != bodies[i]:
                    out.append(i)
                    if cut[i] not in held:
                        if size > HELD_BYTES:
                            held.clear()
                            size = 0
                        held[cut[i]] = bodies[i]
                        size += len(bodies[i]) + 100
            yield pa.RecordBatch.from_arrays([pa.array([cut[i] for i in out], pa.binary()), pa.array([bodies[i] for i in out], pa.binary())], ["digest", "body"])

    found = row_text(known).select("text").mapInArrow(run, "digest binary, body binary")
    return materialise(found.join(shared.select("digest"), "digest", "left_semi"), "bodies")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
}
