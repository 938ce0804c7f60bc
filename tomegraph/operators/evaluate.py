"""Extraction quality: matches, precision, recall, F1, buckets (JOIN-16, JOIN-17, AGG-12, AGG-13, SET-4, SET-5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Counted, best_partners
from ..functions.text import normalized_name


def prf(matches: Column, extracted: Column, labels: Column) -> list[Column]:
    """precision, recall, f1 in percent, 0 for empty denominators."""
    p = F.when(extracted == 0, 0.0).otherwise(100.0 * matches / extracted)
    r = F.when(labels == 0, 0.0).otherwise(100.0 * matches / labels)
    both = extracted + labels
    f = F.when(both == 0, 0.0).otherwise(200.0 * matches / both)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def exact_matches(labels: DataFrame, extracted: DataFrame, underscores: bool = False) -> DataFrame:
    """name, label, extracted: equal in evaluation form; of several names of a form the last by order of name."""
    form = lambda df, out: df.groupBy(normalized_name(F.col("name"), underscores).alias("form")).agg(F.max("name").alias(out)).where("form <> ''")
    return form(labels, "label").join(form(extracted, "extracted"), "form")


def missing(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    form = lambda df: df.select("name", normalized_name(F.col("name")).alias("form"))
    return form(labels).join(form(extracted).select("form").distinct(), "form", "left_anti")


#: Labels that are held against all rows at once, in bytes.
LABEL_BYTES = 1 << 20


def _label_blocks(labels: DataFrame) -> Iterator[list[str]]:
    block, size = [], 0
    for r in labels.select("name").toLocalIterator():
        if size > LABEL_BYTES:
            yield block
            block, size = [], 0
        block.append(r.name)
        size += len(r.name) + 64
    if block:
        yield block


def scored(labels: DataFrame, extracted: DataFrame, threshold: float) -> DataFrame:
    """label, name, score: for each label (name) and task the best of the names (name) that reach the threshold, the smallest of equals.

    The labels are the stated query set, held against all rows block by block; a task gives one row a label at most.
    Bounds from letter counts keep most pairs from being scored, and lose none that could win.
    """
    spark = extracted.sparkSession
    kinds = "label string, name string, score double"

    def held(block: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # bounded by LABEL_BYTES

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[str, tuple[float, str]] = {}
            asked = Counted(sent.value)
            for pdf in it:
                best_partners(asked, Counted(pdf["name"].tolist()), threshold, best)
            yield pd.DataFrame([(q, n, -s) for q, (s, n) in best.items()], columns=["label", "name", "score"])

        return extracted.select("name").mapInPandas(run, kinds)

    out = spark.createDataFrame([], kinds)
    for block in _label_blocks(labels):
        out = out.unionByName(held(block))
    return out.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select("label", "b.name", (-F.col("b.s")).alias("score"))


def _forms(df: DataFrame) -> DataFrame:
    return df.select(normalized_name(F.col("name")).alias("name")).where("name <> ''").distinct()


def greedy_matches(labels: DataFrame, extracted: DataFrame, threshold: float = 80.0) -> DataFrame:
    """label, extracted, score, method, one to one, of names in evaluation form.

    Equal forms first. Then each label left over names the best of all names left over, from the
    threshold on; of several labels that name the same, the first by name has it and the others none.
    """
    a, b = _forms(labels), _forms(extracted)
    exact = a.join(b, "name")
    rest = scored(a.join(b, "name", "left_anti"), b.join(a, "name", "left_anti"), threshold)
    fuzzy = rest.groupBy(F.col("name").alias("extracted")).agg(F.min(F.struct("label", "score")).alias("b"))
    out = exact.select(F.col("name").alias("label"), F.col("name").alias("extracted"), F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
    return out.unionByName(fuzzy.select("b.label", "extracted", "b.score", F.lit("fuzzy").alias("method")))


def best_matches(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    """label, name, score, bucket of the best partner of each label; several labels may share one."""
    return scored(_forms(labels), _forms(extracted), 0.0).withColumn("bucket", bucket(F.col("score")))


def extras(labels: DataFrame, extracted: DataFrame, n: int = 30) -> DataFrame:
    """Extracted names (name, type) that no label equals: per type the first n by name, with their number."""
    from pyspark.sql.window import Window

    known = labels.select(normalized_name(F.col("name")).alias("form")).distinct()
    left = extracted.withColumn("form", normalized_name(F.col("name"))).join(known, "form", "left_anti")
    w = Window.partitionBy("type")
    return left.withColumns({"n": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("name"))}).where(F.col("rank") <= n).select("type", "name", "rank", "n")


def bucket(score: Column) -> Column:
    return F.when(score >= 100, "exact").when(score >= 90, "high").when(score >= 80, "fair").when(score > 0, "low").otherwise("none")
