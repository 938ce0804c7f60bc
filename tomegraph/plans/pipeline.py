"""The staged build of a graph from documents, with stage tables as caches, and its command line (PIPE-1..5)."""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten, graph
from ..session import session
from ..sources import documents as D
from . import stages
from .client import Client, HttpClient, RuleClient
from .ledger import Ledger, Recorded

log = logging.getLogger("tomegraph")
STAGES = ("shadow", "spatial", "mapping", "entity")


class Build:
    """Stages on one set of documents; each writes its tables below `folder`.

    shadow is skipped while its table is of the same input (by a fingerprint of the bodies); spatial
    reuses summaries likewise; the other stages always run. A stage whose prerequisites are missing
    raises FileNotFoundError.
    """

    def __init__(self, spark: SparkSession, source: str | Sequence[str], folder: str, client: Client, force: bool = False):
        self.spark, self.source, self.folder, self.client, self.force = spark, source, folder, client, force

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str) -> DataFrame:
        if not D.exists(self.spark, self._path(name)):
            raise FileNotFoundError(f"{self._path(name)}: run the stages before")
        return self.spark.read.parquet(self._path(name))

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self._path(name))

    def _current(self, name: str, mark: str) -> bool:
        at = self._path(f"{name}.mark")
        return not self.force and D.exists(self.spark, at) and self.spark.read.text(at).first()[0] == mark

    def _marked(self, name: str, mark: str) -> None:
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(f"{name}.mark"))

    def fingerprint(self) -> str:
        docs = D.read_documents(self.spark, self.source)
        r = docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "body").cast("decimal(38,0)"))).first()
        return f"{r[0]}:{r[1]}"

    def shadow(self) -> None:
        mark = self.fingerprint()
        if self._current("sections", mark):
            log.info("sections are current")
            return
        self._write(flatten.flatten(D.read_documents(self.spark, self.source)), "sections")
        self._marked("sections", mark)

    def spatial(self) -> None:
        nodes, mark = self._read("sections"), self.fingerprint()
        if not self._current("summaries", mark):
            self._write(stages.summarise(nodes, self.client), "summaries")
            self._marked("summaries", mark)
        roots = nodes.where("depth = 0").join(self._read("summaries"), ["doc_id", "path"]).where(f"summary IS NOT NULL AND summary <> '{stages.traverse.NO_SPATIAL_INFO}'")
        chapters = stages._path_key(roots).select("key", F.col("summary").alias("text"), F.get("path", 0).cast("long").alias("ord"))
        n, e = stages.chapter_graph(chapters, self.client)
        self._write(n, "location_nodes")
        self._write(e, "location_edges")

    def mapping(self) -> None:
        sections = self._read("sections").where("content <> ''").select(F.concat_ws("/", "doc_id", "node_id").alias("section_id"), F.col("content").alias("text"))
        self._write(stages.map_sections(sections, self._read("location_nodes"), self.client), "section_locations")

    def entity(self) -> None:
        sections = self._read("sections").select(F.concat_ws("/", "doc_id", "node_id").alias("section_id"), "content", "links", F.element_at("path", -1).cast("long").alias("ord"))
        n, e, bad = stages.enrich(sections, self._read("section_locations"), self.client)
        nodes, edges = graph.deduplicate(n, e)
        self._write(nodes, "entity_nodes")
        self._write(edges, "entity_edges")
        self._write(bad, "bad_rows")

    def run(self, names: Sequence[str] = STAGES, dry_run: bool = False, canonical: bool = False) -> list[str]:
        """The named stages in the given order (or in that of the pipeline); `all` stands for every one."""
        order = [s for n in names for s in (STAGES if n == "all" else (n,))]
        if canonical:
            order = [s for s in STAGES if s in order] + [s for s in order if s not in STAGES]
        unknown = [s for s in order if s not in STAGES]
        if unknown:
            raise ValueError(f"no such stage: {', '.join(unknown)}")
        for s in order:
            log.info("%s%s", s, " (dry run)" if dry_run else "")
            if not dry_run:
                getattr(self, s)()
        return order


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Build a knowledge graph from nested documents.")
    p.add_argument("--stage", action="append", choices=[*STAGES, "all"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--model")
    p.add_argument("--base-url")
    p.add_argument("--concurrency", type=int, help="calls in flight a task; LLM_CONCURRENCY or the kind of model decide otherwise")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if a.concurrency:
        os.environ["LLM_CONCURRENCY"] = str(a.concurrency)
    client = HttpClient(a.base_url, a.model or "") if a.base_url else RuleClient()
    spark = session()
    client = Recorded(client, Ledger(spark, f"{a.output.rstrip('/')}/calls"))  # a run that was killed goes on from there
    Build(spark, a.input, a.output, client, a.force).run(a.stage or ["all"], a.dry_run)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
