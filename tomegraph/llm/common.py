"""Helpers shared by the corpus operators: scratch tables, row identity, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object, in bytes, that an operator here sends to every task.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder on a local master and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_KNOWN_ROOTS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    root = f"{_shared_folder(spark)}/corpus-{spark.sparkContext.applicationId}"
    if root not in _KNOWN_ROOTS:
        _KNOWN_ROOTS.add(root)
        atexit.register(_remove, root)
    return root


def _remove(path: str) -> None:
    """Delete a scratch table or folder, if the driver's JVM is still there."""
    with contextlib.suppress(Exception):
        jvm = SparkContext._gateway.jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows in an Arrow batch of whole texts, on both sides of the pipe to Python.
BATCH_ROWS = 1000


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within the block texts go to Python in batches of that many rows at most; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(int(old), rows) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def materialise(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _written(df, scratch_path(df.sparkSession, label), batch_rows)


def _written(df: DataFrame, path: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    with bounded_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain_scan(df: DataFrame) -> bool:
    """df is files and, over them, nothing but projections and filters: a row of df is a row of a file."""
    plan = getattr(df, "_jdf", None)
    if plan is None or "_metadata" in df.columns:
        return False
    plan = plan.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


#: Bits for the row within a file; the file's number stands above them.
_ROW_BITS = 36


def identified(docs: DataFrame) -> DataFrame:
    """doc (struct of all columns) and row, a number of its own for each row, the same in every run of the plan.

    Rows of Parquet files are named by file and place in it, without moving or writing a text; other
    inputs are written first. Equal and null doc_ids are thereby told apart, and no column clashes.
    """
    if _plain_scan(docs):
        with contextlib.suppress(AnalysisException):  # files of another format have no row numbers
            meta = docs.metadataColumn("_metadata")
            named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), meta.getField("row_index").alias("row"), meta.getField("file_path").alias("path"))
            files = sorted(r.path for r in named.select("path").distinct().toLocalIterator())
            if len(files) < 2:
                return named.select("doc", "row")
            # as an Arrow table: rows of a list would go through Python workers of their own, which then stay
            number = docs.sparkSession.createDataFrame(pa.table({"path": files, "first": pa.array([i << _ROW_BITS for i in range(len(files))], pa.int64())}))
            if sum(map(len, files)) + 64 * len(files) <= BROADCAST_BYTES:
                number = F.broadcast(number)
            return named.join(number, "path").select("doc", (F.col("first") + F.col("row")).alias("row"))
    return materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, as long and string."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_text(known: DataFrame) -> DataFrame:
    """row, doc_id and text of identified() rows."""
    return known.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


#: Rows without a doc_id come after all others.
LAST_ID = (1 << 63) - 1


def without(known: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of identified() rows less those whose number is in gone (row); gone is sent to the tasks while it is small."""
    if gone.count() * 32 <= BROADCAST_BYTES // 4:
        gone = F.broadcast(gone)
    return known.join(gone, "row", "left_anti").select("doc.*")


#: Stands for a null id inside number arrays; no other row may carry it.
NULL_ID = -(1 << 63)


#: Drops what tasks left in this worker for further ones of their kind, by name.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only a slice's texts are Python objects at a time.

    What tasks of other kinds left in the worker goes first, but for `keep`. At the end of the task
    freed memory goes back to the system, for the worker stays for the next one.
    """
    for name in [n for n in KEPT if n != keep]:
        KEPT.pop(name)()
        release()
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        release()


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root), root the smallest node.

    Alternates the large-star and small-star steps until the edge set is stable; every step is a
    min-aggregate plus an equi-join, so no component has to fit into a task. Nodes that are in no
    edge are absent from the result. Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    e = _written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    digest = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    old = digest(e)
    for _ in range(rounds if old[0] else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: hang every larger neighbour on the smallest node of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: hang the node and its smaller neighbours on the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, path = path, scratch_path(spark, "edges")
        e = _written(small, path)
        _remove(last)
        now = digest(e)
        if now == old:
            break
        old = now
    else:
        if old[0]:
            raise RuntimeError(f"components: not stable after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
