"""Graphs and events as streams: an addition beside the batch operators, which know no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import graph
from ..sources.documents import exists
from ..sources.keyed import KeyedTable


def merge_nodes(stream: DataFrame, path: str, checkpoint: str):
    """Fragments of nodes (id, label, type, ord) upserted into tables below path, one per batch, by longest label.

    A batch writes a version of its own from the one before, so a batch that is run again gives the
    same table.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{n - 1}"
        base = spark.read.parquet(before) if n and exists(spark, before) else batch.limit(0)
        merged = graph.longest_label(base.unionByName(batch.withColumn("ord", F.lit((n + 1) << 40) + F.col("ord"))))
        merged.write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, order: str | None = None):
    """Batches upserted into a keyed table: each rewrites the files it touches, and one that is run again changes nothing."""

    def upsert(batch: DataFrame, n: int) -> None:
        table.upsert(batch, order, (name, n))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def longest_labels(nodes: DataFrame) -> DataFrame:
    """id, label: emits an id again whenever a longer label arrives; state is one label an id."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = old = state.get[0] if state.exists else None
        for pdf in pdfs:
            for label in pdf["label"].dropna():
                if best is None or len(label) > len(best):
                    best = label
        if best is not None and best != old:
            state.update((best,))
            yield pd.DataFrame({"id": [key[0]], "label": [best]})

    return nodes.select("id", "label").groupBy("id").applyInPandasWithState(step, "id string, label string", "label string", "update", GroupStateTimeout.NoTimeout)
