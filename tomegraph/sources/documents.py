"""Document and reply files to tables (SRC-1, 3, 9..13, PAR inputs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file systems, so any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """doc_id (the file), body of JSON files, one row each; a missing path raises FileNotFoundError."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if not any(c in p for c in "*?[{") and not exists(spark, p):
            raise FileNotFoundError(p)
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("body"))


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first table that exists (a summarised one before the plain one)."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """name, line_no (from 1) of a label file; blank lines and # comments are skipped."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "name"))
    return whole.select(F.trim("name").alias("name"), (F.col("i") + 1).alias("line_no")).where("name <> '' AND name NOT LIKE '#%'")


def projects(spark: SparkSession, folder: str) -> list[str]:
    """Sorted stems of a folder's JSON files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))
