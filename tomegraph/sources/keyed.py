"""Keyed tables on shared storage, of which an upsert rewrites only the files it touches (SNK-6..8).

Rows lie in Parquet folders, each of which holds one range of keys. A version is a small JSON manifest: the
lowest key of every folder, the folder and its rows. An upsert or a delete finds the ranges its keys fall
into, reads and writes those folders, and commits by putting the next manifest in place; folders
outside these ranges keep their names. Ranges that have grown beyond rows_per_file are split while they
are rewritten.

Two writers can't commit the same version: the second starts over on the first one's result. A batch that
carries (stream, number) is committed with its number, so a replay changes nothing. Readers keep the
version they opened until vacuum() drops it. The store must rename without overwriting (HDFS and local disks do).

Defined cases: equal keys in a batch leave the row of the highest order, of equal orders the largest row; null keys are keys
like others; an empty batch commits its number only; a table nobody has written to can't be read.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialise, remove

#: Rows of a folder, above which it is split the next time it is written.
ROWS_PER_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.keys, self.rows_per_file = spark, path.rstrip("/"), list(keys), rows_per_file

    # --- versions -------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        where, fs = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(where):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """files ([lowest key, folder, rows] by key), schema and last batches of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "files": [], "schema": None, "batches": {}}
        where, fs = self._hadoop(f"{self.path}/manifests/{version:012}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """The manifest under its version's name, unless that is taken."""
        jvm, version = self.spark._jvm, manifest["version"]
        draft, fs = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        target, _ = self._hadoop(f"{self.path}/manifests/{version:012}.json")
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), no_options)
        except Exception as e:
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                fs.delete(draft, False)
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise
        return version

    # --- reading --------------------------------------------------------------------------------

    def _frame(self, files: Sequence, schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for _, f, _ in files))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        return self._frame(m["files"], m["schema"])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted keys, from the folders whose ranges they fall into."""
        m = self.manifest()
        asked = materialise(self._placed(wanted.select(*self.keys).distinct(), m["files"]), "asked")
        return self._frame(self._touched(asked, m["files"]), m["schema"]).alias("t").join(asked.alias("n"), self._same(), "left_semi")

    # --- writing --------------------------------------------------------------------------------

    def _sort_key(self) -> Column:
        one = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))
        return F.concat_ws("\0", *(one(c) for c in self.keys))

    def _same(self) -> Column:
        both = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.keys]
        out = both[0]
        for c in both[1:]:
            out = out & c
        return out

    def _placed(self, rows: DataFrame, files: Sequence) -> DataFrame:
        """rows with _key and _range, the number of the range that the key falls into."""
        lows = [f[0] for f in files]

        @F.pandas_udf("int")
        def place(key: pd.Series) -> pd.Series:
            return key.map(lambda k: max(0, bisect_right(lows, k) - 1)).astype("int32")

        keyed = rows.withColumn("_key", self._sort_key())
        return keyed.withColumn("_range", place("_key") if len(lows) > 1 else F.lit(0))

    def _touched(self, placed: DataFrame, files: Sequence) -> list:
        """Files whose range has a row; their numbers, at most one a file, come to the driver."""
        numbers = sorted(r[0] for r in placed.select("_range").distinct().collect())
        return [files[i] for i in numbers if i < len(files)]

    def _replace(self, m: dict, touched: list, rows: DataFrame, total: int, schema: str, batch: tuple[str, int] | None) -> int:
        """Commit m with the rows (with _key, _range) in place of the touched files."""
        added = []
        if total:
            folder = f"data/{uuid.uuid4().hex}"
            parts = max(1, -(-total // self.rows_per_file))
            laid = rows.repartitionByRange(parts, "_range", "_key").withColumn("_file", F.concat(F.lit("f"), F.col("_range"), F.lit("-"), F.spark_partition_id()))
            laid.sortWithinPartitions("_file", "_key").drop("_key", "_range").write.partitionBy("_file").parquet(f"{self.path}/{folder}")
            kind = StructType.fromJson(json.loads(schema)).add("_file", "string")
            back = self.spark.read.schema(kind).parquet(f"{self.path}/{folder}").withColumn("_key", self._sort_key())
            added = [[r.low, f"{folder}/_file={r._file}", r.n] for r in back.groupBy("_file").agg(F.min("_key").alias("low"), F.count("*").alias("n")).collect()]  # a row a file
        gone = {f[1] for f in touched}
        files = sorted([f for f in m["files"] if f[1] not in gone] + added)
        batches = {**m["batches"], **({batch[0]: batch[1]} if batch else {})}
        return self._commit({"version": m["version"] + 1, "files": files, "schema": schema, "batches": batches})

    def _again(self, step, tries: int) -> int:
        for left in reversed(range(tries)):
            try:
                return step()
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Rows replace those of equal keys; the version that holds them. order tells which of equal keys in rows stays."""
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *rest)).alias("_best") if rest else F.count("*").alias("_best")
        new = rows.groupBy(*self.keys).agg(best)
        new = materialise(new.select(*((F.col(c) if c in self.keys else F.col(f"_best.{c}").alias(c)) for c in rows.columns)), "coming")
        schema = json.dumps(rows.schema.jsonValue())

        def step() -> int:
            m = self.manifest()
            if batch and m["batches"].get(batch[0], -1) >= batch[1]:
                return m["version"]
            kind = m["schema"] or schema
            placed = self._placed(new, m["files"])
            touched = self._touched(placed, m["files"])
            old = self._placed(self._frame(touched, kind), m["files"])
            kept = old.alias("t").join(new.alias("n"), self._same(), "left_anti")
            return self._replace(m, touched, kept.unionByName(placed), sum(f[2] for f in touched) + new.count(), kind, batch)

        return self._again(step, tries)

    def delete(self, gone: DataFrame, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """The rows of these keys leave; the version without them."""
        asked = materialise(gone.select(*self.keys).distinct(), "gone")

        def step() -> int:
            m = self.manifest()
            if not m["files"] or (batch and m["batches"].get(batch[0], -1) >= batch[1]):
                return m["version"]
            touched = self._touched(self._placed(asked, m["files"]), m["files"])
            old = self._placed(self._frame(touched, m["schema"]), m["files"])
            left = old.alias("t").join(asked.alias("n"), self._same(), "left_anti")
            return self._replace(m, touched, left, sum(f[2] for f in touched), m["schema"], batch)

        return self._again(step, tries)

    def vacuum(self, keep: int = 1) -> int:
        """Drop manifests before the last `keep` versions and the folders that only those name; how many went."""
        last = self.version()
        named = {f[1] for v in range(max(1, last - keep + 1), last + 1) for f in self.manifest(v)["files"]}
        old = {f[1] for v in self._held() if v <= last - keep for f in self.manifest(v)["files"]} - named
        for v in self._held():
            if v <= last - keep:
                remove(f"{self.path}/manifests/{v:012}.json")
        for f in old:
            remove(f"{self.path}/{f}")
        return len(old)

    def _held(self) -> list[int]:
        where, fs = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))


def upsert_graph(nodes: KeyedTable, edges: KeyedTable, new_nodes: DataFrame, new_edges: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Nodes by id, then the edges whose two ends exist; the versions of both tables."""
    at = nodes.upsert(new_nodes, order, batch)
    coming = materialise(new_edges, "edges")
    there = materialise(nodes.lookup(coming.select(F.explode(F.array("source", "target")).alias("id"))).select("id"), "there")
    for end in ("source", "target"):
        coming = coming.join(there.select(F.col("id").alias(end)), end, "left_semi")
    return {"nodes": at, "edges": edges.upsert(coming.select(new_edges.columns), order, batch)}
