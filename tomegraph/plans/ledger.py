"""A ledger of model calls that runs can be resumed from (LLM-13, SNK-4, LLM-9).

The ledger is a folder of Parquet parts with a row a call, failures and truncations too. Before prompts go out
they are held against its good replies by prompt hash, equal prompts go out once, and what was asked is
committed in parts of PART_CALLS. A run that is killed therefore pays again for one part at most.
A failed call stays in the ledger and is asked again by the next run.

Defined cases: a null prompt counts as an empty one; of several replies to a prompt the first good one in
order of its text holds; an empty table of prompts asks nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import LLM_CALLS
from ..session import materialise
from ..sources.documents import exists
from .client import Client, asked, concurrency

PART_CALLS = 5000
#: Sections of each document that a sequential extraction commits at a time.
STEP = 20


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def rows(self) -> DataFrame:
        """All calls ever committed."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LLM_CALLS)
        return self.spark.read.schema(LLM_CALLS).parquet(self.path)

    def add(self, calls: DataFrame) -> None:
        calls.write.mode("append").parquet(self.path)

    def replies(self, stage: str) -> DataFrame:
        """prompt_hash and one good row (reply) of each prompt of a stage that was answered."""
        good = self.rows.where((F.col("stage") == stage) & (F.col("status") == "ok"))
        return good.groupBy("prompt_hash").agg(F.min(F.struct("response", "finish_reason")).alias("reply"))

    def call(self, prompts: DataFrame, client: Client, stage: str, part_calls: int = PART_CALLS, in_flight: int | None = None, **params) -> DataFrame:
        """llm_calls of prompts (key, prompt), one row each: from the ledger where it has a reply, else asked and committed part by part."""
        text = F.coalesce("prompt", F.lit(""))
        hashed = prompts.select(F.col("key").cast("string").alias("key"), text.alias("prompt"), F.sha2(F.concat(F.lit(f"{stage}\x00"), text), 256).alias("prompt_hash"))
        hashed = materialise(hashed, "prompts")
        open_ = hashed.join(self.replies(stage).select("prompt_hash"), "prompt_hash", "left_anti")
        open_ = materialise(open_.groupBy("prompt_hash").agg(F.min(F.struct("key", "prompt")).alias("p")).select("p.*", "prompt_hash"), "open")
        parts = -(-open_.count() // part_calls)
        failed = None
        for i in range(parts):
            share = open_.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)) == i)
            got = asked(share, client, stage, in_flight or concurrency(getattr(client, "model", "")), **params)
            got = materialise(got, f"calls-{stage}")
            self.add(got)
            bad = got.where("status <> 'ok'").select("prompt_hash", "status", "error")
            failed = bad if failed is None else failed.unionByName(bad)
        out = hashed.join(self.replies(stage), "prompt_hash", "left")
        if failed is None:
            failed = self.spark.createDataFrame([], "prompt_hash string, status string, error string")
        out = out.join(failed, "prompt_hash", "left")
        return out.select("prompt_hash", F.lit(stage).alias("stage"), "key", "prompt", "reply.response", F.coalesce("status", F.lit("ok")).alias("status"), "error", "reply.finish_reason")


class Recorded:
    """A client whose calls go through a ledger, in every stage that it is given to."""

    def __init__(self, client: Client, ledger: Ledger):
        self.client, self.ledger, self.model = client, ledger, getattr(client, "model", "")

    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        return self.client.complete(prompt, params)


def in_steps(ledger: Ledger, stage: str, sections: DataFrame, run, fields: str, step: int = STEP) -> DataFrame:
    """Run a sequential extraction of documents (run(sections, known replies by hash) -> rows with `call`), a step of sections at a time.

    Every step replays the replies before it, which costs no call, asks for its own sections and commits these calls.
    """
    placed = sections.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("place"), "path", "content")
    placed = materialise(placed, "in-order")
    most = placed.agg(F.max("place")).first()[0] or 0
    for upto in range(step, most + step, step):
        known = ledger.replies(stage).join(_documents(ledger, stage), "prompt_hash").select("doc_id", "prompt_hash", "reply.response", "reply.finish_reason")

        def one(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            return run(pdf, {r.prompt_hash: (r.response, r.finish_reason) for r in replies.itertuples()})

        now = placed.where(F.col("place") <= upto).groupBy("doc_id").cogroup(known.groupBy("doc_id")).applyInPandas(one, fields)
        out = materialise(now, f"extracted-{stage}")
        ledger.add(out.select("call.*").join(ledger.replies(stage).select("prompt_hash"), "prompt_hash", "left_anti").select(*[c.split(" ")[0] for c in LLM_CALLS.split(", ")]))
    return out if most else ledger.spark.createDataFrame([], fields)


def _documents(ledger: Ledger, stage: str) -> DataFrame:
    """The document of each sequential call, which stands before the last slash of its key."""
    return ledger.rows.where(F.col("stage") == stage).select("prompt_hash", F.regexp_extract("key", "(?s)^(.*)/[^/]*$", 1).alias("doc_id")).distinct()
