"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, best-fit packing.

Each stage works on all its predecessor kept, takes (spark, docs, sf_dir) and, but for the last,
returns the columns of documents. Stages decide on rows, not on ids: rows of equal or without
doc_id are told apart by their place in the input, and each is judged by its own text. A null text
is an empty one and an empty table gives no rows, in every stage. The results can't be told in SQL (a trained network, edit
distances, similarity groups, packing), so ORACLE_SQL is None and tests hold the stages against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegraph.llm import decontamination, line_dedup, packing, quality, simhash
from tomegraph.llm.common import identified, materialise, table, without
from tomegraph.llm.tokens import vocabulary

CAPACITY, END_ID = 4096, 1


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, accepts."""
    return quality.Classifier.fit(docs, table(spark, sf_dir, "labels")).accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier document or line has; documents of which only blanks are left go."""
    cleaned = line_dedup.clean(docs).where("NOT spent")
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return cleaned.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group linked by five-word shingle similarities of 0.8 or more.

    Of rows with that id the first stays; rows without an id stay only where their group has no other.
    """
    known = identified(docs)
    return without(known, materialise(simhash.near_rows(known).where("row <> keep_row").select("row"), "near-copies"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are no more than one word in twenty."""
    known = identified(docs)
    found = decontamination.row_verdicts(decontamination.build_index(known), table(spark, sf_dir, "benchmark"))
    return without(known, materialise(found.where("contaminated").select("row"), "contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.pack(packing.pieces(docs, vocabulary(), END_ID, CAPACITY), CAPACITY)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
