"""Aliases, mentions and canonical ids (FN-7, FN-8, JOIN-11, JOIN-12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containment
from ..functions import text as T
from ..functions.similarity import similar_labels
from . import graph

#: Letters of a label that two labels share before their similarity is measured.
BLOCK_PREFIX = 5


def alias_map(nodes: DataFrame, legacy: bool = False) -> DataFrame:
    """alias, id of nodes (id, label, aliases, ord), a later node winning.

    Normalised label, its word pairs and aliases; `legacy` keeps the raw id, label and aliases.
    """
    if legacy:
        keys = F.concat(F.array("id", "label"), F.coalesce("aliases", F.array()))
    else:
        keys = F.concat(T.alias_forms(F.col("label")), F.transform(F.coalesce("aliases", F.array()), lambda a: F.lower(F.replace(a, F.lit("_"), F.lit(" ")))))
    each = nodes.select("id", "ord", F.explode(keys).alias("alias")).where(~T.is_blank(F.col("alias")))
    return graph.last_wins(each, ["alias"]).select("alias", "id")


def mentions(sections: DataFrame, aliases: DataFrame, least: int = 1) -> DataFrame:
    """section_id, ids (sorted): aliases of any length that the content holds, inside words too.

    Case aside, and underscores count as blanks. Sections with fewer than `least` different ids are
    left out; rows of one section_id count together.
    """
    texts = sections.select(F.col("section_id").cast("string").alias("key"), F.replace("content", F.lit("_"), F.lit(" ")).alias("text"))
    hit = containment.mentioned(texts, aliases.select(F.col("id").cast("string").alias("term_id"), F.col("alias").alias("term")))
    hit = hit.groupBy(F.col("key").alias("section_id")).agg(F.array_sort(F.collect_set("term_id")).alias("ids"))
    return hit.where(F.size("ids") >= least)


def _edits(longest: int) -> int:
    """Edits that the label rule allows when the longer label has so many letters."""
    return max(2, int(0.2 * longest))


def _cuts(length: int) -> list[int]:
    """Where a label of this length is cut into one piece more than it may have edits, so one stays whole."""
    n = _edits(length) + 1
    return [length * i // n for i in range(n + 1)]


def _own_pieces(label: str) -> list[str]:
    cuts = _cuts(len(label))
    return [f"{len(label)}:{i}:{label[a:b]}" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _met_pieces(label: str) -> list[str]:
    """Every piece that a label as long or longer, and within its edits, can have kept whole.

    Piece i is no more than i places off, or has the pieces after it to make up for the rest.
    """
    out, n, longer = set(), len(label), len(label)
    while longer - (d := _edits(longer)) <= n:
        for i, (a, b) in enumerate(zip(cuts := _cuts(longer), cuts[1:], strict=False)):
            low, high = max(0, a - i, a + n - longer - (d - i)), min(n - (b - a), a + i, a + n - longer + (d - i))
            out.update(f"{longer}:{i}:{label[x : x + b - a]}" for x in range(low, high + 1))
        longer += 1
    return sorted(out)


def _keys(label: Column, of) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([of(v) for v in x])

    return run(label)


def similar_pairs(labels: DataFrame) -> DataFrame:
    """a < b of all the distinct labels (label) that the label rule holds similar; blank ones are like nothing.

    Of a label cut into one piece more than the edits allowed, one piece at least is whole in the
    other label, so pieces are exact keys; labels inside others are found by containment.
    """
    n = labels.select("label").where("label <> ''").distinct()
    long = n.select(F.col("label").alias("x"), F.explode(_keys(F.col("label"), _own_pieces)).alias("key"))
    short = n.select(F.col("label").alias("y"), F.explode(_keys(F.col("label"), _met_pieces)).alias("key"))
    near = long.join(short, "key").where("x <> y").select("x", "y")
    inside = containment.contained(n.select(F.col("label").alias("hay_id"), F.col("label").alias("hay")), n.select(F.col("label").alias("needle_id"), F.col("label").alias("needle")))
    every = near.unionByName(inside.where("hay <> needle").select(F.col("hay").alias("x"), F.col("needle").alias("y")))
    pairs = every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(similar_labels(F.col("a"), F.col("b")))


def canonical_ids(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """raw (id, label, aliases if it has them) to new_id of unique (id, label, aliases, ord), and the tier.

    In this order: id (1), label (2), the raw entity's own aliases that are a label (5), its label as
    an alias (3), similar labels (4). Labels are compared in normalised form. Similarity is measured
    for blocks of the first BLOCK_PREFIX letters: the raw label's own, that less its last letter, and
    that with an `a`; in a tier the first by block, then by ord, holds.
    """
    forms = lambda of: F.transform(F.coalesce(of, F.array().cast("array<string>")), lambda a: T.normalized_label(a))
    norm = lambda c: T.normalized_label(F.col(c))
    r = raw.select("id", norm("label").alias("name")).distinct()
    u = unique.select(F.col("id").alias("uid"), norm("label").alias("uname"), "ord", forms(F.col("aliases")).alias("forms"))

    def hits(df: DataFrame, rank: int, tier: int, block=None) -> DataFrame:
        return df.select("id", F.lit(rank).alias("rank"), (F.lit(0) if block is None else block).alias("block"), "ord", "uid", F.lit(tier).alias("tier"))

    every = hits(r.join(u, r.id == u.uid), 1, 1)
    every = every.unionByName(hits(r.join(u, (r.name == u.uname) & (F.col("name") != "")), 2, 2))
    if "aliases" in raw.columns:
        named = raw.select("id", F.explode(forms(F.col("aliases"))).alias("form")).where("form <> ''").distinct()
        every = every.unionByName(hits(named.join(u, F.col("form") == F.col("uname")), 3, 5))
    every = every.unionByName(hits(r.join(u.select("uid", "ord", F.explode("forms").alias("form")), F.col("name") == F.col("form")).where("name <> ''"), 4, 3))
    first = F.substring("name", 1, BLOCK_PREFIX)
    keyed = r.select("id", "name", F.posexplode(F.array(first, F.expr(f"left(name, least(length(name), {BLOCK_PREFIX}) - 1)"), F.concat(first, F.lit("a")))).alias("block", "key"))
    near = keyed.where("key <> ''").join(u, F.col("key") == F.substring("uname", 1, BLOCK_PREFIX)).where(similar_labels(F.col("name"), F.col("uname")))
    every = every.unionByName(hits(near, 5, 4, F.col("block")))
    best = every.groupBy("id").agg(F.min(F.struct("rank", "block", "ord", "uid", "tier")).alias("b"))
    return r.select("id").distinct().join(best, "id", "left").select(F.col("id").alias("old_id"), F.coalesce("b.uid", "id").alias("new_id"), F.col("b.tier").alias("tier"))
