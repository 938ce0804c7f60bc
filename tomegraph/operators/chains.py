"""Chains of one link a row, followed by pointer doubling (JOIN-10, PIPE-7, merge maps).

links holds (id, parent). Every round joins the pointers with themselves, so a chain of n links takes
log2(n) rounds and nothing stops half-way. What is still moving after as many steps as there are
ids can't end: it is in a cycle or leads into one.

Defined cases: a null parent and a link to itself are ends; of several parents the smallest counts; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _clean(links: DataFrame) -> DataFrame:
    return links.where("id IS NOT NULL AND parent IS NOT NULL AND id <> parent").groupBy("id").agg(F.min("parent").alias("parent"))


def ends(links: DataFrame) -> DataFrame:
    """id, root, distance, cyclic of every id with a link.

    root is the last id of the chain and distance the links to it; in or before a cycle root is the
    cycle's smallest id and distance is null.
    """
    at = materialise(_clean(links).select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("d"), F.col("parent").alias("low"), F.lit(False).alias("done")), "pointers")
    n, step = at.count(), 1
    while n and not at.where("NOT done").isEmpty():
        onward = at.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("d").alias("_d"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        moved = at.where("NOT done").join(onward, F.col("at") == F.col("_id"), "left")
        last = F.col("_id").isNull()
        moved = moved.select("id", F.coalesce("_at", "at").alias("at"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.least("low", F.coalesce("_low", "low")).alias("low"), (last | F.col("_done")).alias("done"))
        at = materialise(at.where("done").unionByName(moved), "pointers")
        step *= 2
        if step > 2 * n:
            break
    # whoever still moves stands on its cycle now, and low of that place has seen the whole of it
    there = at.where("NOT done").select(F.col("id").alias("_id"), F.col("low").alias("cycle"))
    open_ = at.where("NOT done").join(there, F.col("at") == F.col("_id")).select("id", F.col("cycle").alias("root"), F.lit(None).cast("long").alias("distance"), F.lit(True).alias("cyclic"))
    return at.where("done").select("id", F.col("at").alias("root"), F.col("d").alias("distance"), F.lit(False).alias("cyclic")).unionByName(open_)


def cycles(links: DataFrame) -> DataFrame:
    """id, root of every id that is in a cycle or leads into one; root is the cycle's smallest id."""
    return ends(links).where("cyclic").select("id", "root")


def lineage(links: DataFrame, depth: int) -> DataFrame:
    """id, ancestors: up to depth of them, nearest first, in log2(depth) joins; a cycle repeats its ids up to the depth."""
    paths = materialise(_clean(links).select("id", F.array("parent").alias("ancestors")), "lineage")
    reach = 1
    while reach < depth:
        onward = paths.select(F.col("id").alias("_id"), F.col("ancestors").alias("_more"))
        joined = paths.withColumn("_last", F.element_at("ancestors", -1)).join(onward, F.col("_last") == F.col("_id"), "left")
        longer = F.when(F.size("ancestors") < reach, F.col("ancestors")).otherwise(F.concat("ancestors", F.coalesce("_more", F.slice("ancestors", 1, 0))))
        paths = materialise(joined.select("id", F.slice(longer, 1, depth).alias("ancestors")), "lineage")
        reach *= 2
    return paths
