"""Substring joins without a cross product: rare three-letter pieces as keys, then the true test."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """hay (hay_id, hay) with needles (needle_id, needle) it contains; blank needles match nothing.

    A needle is looked up by the one of its grams that fewest texts have, so common pieces don't
    decide the work; a needle shorter than GRAM is looked up whole, among the texts' pieces of its
    length.
    """
    needles = needles.where(F.coalesce(F.length("needle"), F.lit(0)) > 0)
    sizes = [n for n in range(1, GRAM + 1)]
    size = F.least(F.length("needle"), F.lit(GRAM))
    used = {r[0] for r in needles.select(size.alias("n")).distinct().collect()}  # at most GRAM numbers
    out = None
    for n in (n for n in sizes if n in used):
        pieces = hay.select("hay_id", "hay", F.explode(_grams(F.col("hay"), n)).alias("gram"))
        own = needles.where(size == n).select("needle_id", "needle", F.explode(_grams(F.col("needle"), n)).alias("gram"))
        rare = pieces.groupBy("gram").agg(F.count("*").alias("n"))
        best = own.join(rare, "gram", "left").groupBy("needle_id", "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        hit = pieces.join(best, "gram").where(F.contains("hay", F.col("needle"))).select("hay_id", "hay", "needle_id", "needle")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = hay.select("hay_id", "hay").limit(0).join(needles.select("needle_id", "needle").limit(0), F.lit(False))
    return out


#: Terms that are sent to the tasks at once, in bytes.
TERM_BYTES = 8 << 20


def _blocks(terms: DataFrame | list[tuple]) -> Iterator[list[tuple]]:
    """(term_id, term) in lists of TERM_BYTES at most, one of them on the driver at a time."""
    rows = terms if isinstance(terms, list) else terms.select("term_id", "term").toLocalIterator()
    block, size = [], 0
    for i, t in rows:
        if t:
            if size > TERM_BYTES:
                yield block
                block, size = [], 0
            block.append((i, t.lower()))
            size += len(t) + 64
    if block:
        yield block


def automaton(terms: list[tuple]):
    """Finds all of the terms (id, lower-cased term) in one run over a text."""
    import ahocorasick

    ids: dict[str, list] = {}
    for i, t in terms:
        ids.setdefault(t, []).append(i)
    auto = ahocorasick.Automaton()
    for t, i in ids.items():
        auto.add_word(t, (tuple(i), t))
    auto.make_automaton()
    return auto


def occurrences(texts: DataFrame, terms: DataFrame | list[tuple[int, str]], context: int = 30) -> DataFrame:
    """Per text (id, text) and term: term_id, n (overlaps aside), first place and context of it in the text as it is; case aside.

    The terms (term_id, term; a table or a list) are a stated query set in blocks of bounded size: an
    automaton of a block runs over each text once.
    """
    spark = texts.sparkSession
    kinds = "id long, term_id long, n long, at long, context string"

    def found(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # bounded by TERM_BYTES

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto = automaton(sent.value)
            for pdf in it:
                rows = []
                for key, text in zip(pdf["id"], pdf["text"], strict=True):
                    text = text or ""
                    low, hits = text.lower(), {}
                    for end, (ids, t) in auto.iter(low):
                        start = end - len(t) + 1
                        for i in ids:
                            f = hits.setdefault(i, [0, start, -1, len(t)])
                            if start > f[2]:
                                f[0] += 1
                                f[2] = end
                    # some letters are longer in lower case: own[i] is the letter of the text that low[i] comes from
                    own = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
                    rows += [(key, i, n, own[at], text[max(0, own[at] - context) : own[at + size - 1] + 1 + context]) for i, (n, at, _, size) in sorted(hits.items())]
                yield pd.DataFrame(rows, columns=["id", "term_id", "n", "at", "context"])

        return texts.select("id", "text").mapInPandas(run, kinds)

    out = spark.createDataFrame([], kinds)
    for block in _blocks(terms):
        out = out.unionByName(found(block))
    return out


def mentioned(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term_id of texts (key, text) and terms (term_id, term, both strings) that stand anywhere in them, inside words too; case aside."""
    spark = texts.sparkSession

    def found(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # bounded by TERM_BYTES

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto = automaton(sent.value)
            for pdf in it:
                rows = [(key, i) for key, text in zip(pdf["key"], pdf["text"], strict=True) for i in sorted({i for _, (ids, _) in auto.iter((text or "").lower()) for i in ids})]
                yield pd.DataFrame(rows, columns=["key", "term_id"])

        return texts.select("key", "text").mapInPandas(run, "key string, term_id string")

    out = spark.createDataFrame([], "key string, term_id string")
    for block in _blocks(terms):
        out = out.unionByName(found(block))
    return out
