"""Catalog files to one table of records (SRC-4..8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph

#: The keys that hold records of each kind.
KEYS = {"creature": ("monster",), "item": ("item", "itemGroup", "baseitem"), "spell": ("spell",)}


def read_catalog(docs: DataFrame, kind: str, keys: Sequence[str] | None = None) -> DataFrame:
    """ord, name, source, body of documents (doc_id, body), in order of files, keys and places.

    Text that isn't JSON has no records. A source that is no string is written as one.
    """
    parsed = docs.select("doc_id", F.try_parse_json("body").alias("v"))
    parts = None
    for k, key in enumerate(keys or KEYS[kind]):
        each = parsed.select("doc_id", F.posexplode(F.try_variant_get("v", f"$.{key}", "array<variant>")).alias("i", "r")).withColumn("k", F.lit(k))
        parts = each if parts is None else parts.unionByName(each)
    # files are few: their order by name is a small ranking, records keep their place within
    files = docs.select("doc_id").distinct().select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("f"))
    ord = F.col("f") * (1 << 40) + F.col("k") * (1 << 36) + F.col("i")
    rows = parts.join(files, "doc_id").select(ord.alias("ord"), F.try_variant_get("r", "$.name", "string").alias("name"), F.coalesce(F.try_variant_get("r", "$.source", "string"), F.lit("")).alias("source"), F.to_json("r").alias("body"))
    return rows.where("name IS NOT NULL")


def index(catalog: DataFrame) -> DataFrame:
    """The last record of each (name, source), case and outer blanks aside."""
    keyed = catalog.withColumns({"_n": F.lower(F.trim("name")), "_s": F.lower(F.trim("source"))})
    return graph.last_wins(keyed, ["_n", "_s"]).drop("_n", "_s")
