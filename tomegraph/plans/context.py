"""Retrieval over a graph: similar nodes, their neighbourhood, lines of context, an answer (GRA-9, 12, 13, LLM-12, PIPE-8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, paths, search
from .client import Client

NOTHING = "No relevant information found in the knowledge graph."
TOP_NODES, TOP_EDGES, HOPS = 3, 2, 1


def ego_context(nodes: DataFrame, edges: DataFrame, hits: DataFrame, hops: int = HOPS) -> DataFrame:
    """seed_rank, source_id, relationship, target_id, line around hits (id, seed_ord), each edge once."""
    near = paths.ego_edges(edges.select("source", "target", "relation", "desc"), hits, hops)
    named = graph.labelled(near, nodes)
    line = T.edge_line(F.col("source_label"), F.col("relation"), F.col("target_label"), F.col("desc"))
    return named.select(F.col("seed_ord").alias("seed_rank"), F.col("source").alias("source_id"), F.col("relation").alias("relationship"), F.col("target").alias("target_id"), line.alias("line"))


def edge_lines(nodes: DataFrame, edges: DataFrame, query: list[float], k: int = TOP_EDGES) -> DataFrame:
    """score, ord, line of the k edges closest to a query vector."""
    named = graph.labelled(search.top_k(edges.where("embedding IS NOT NULL"), query, k), nodes)
    return named.select("score", "ord", T.edge_line(F.col("source_label"), F.col("relation"), F.col("target_label"), F.col("desc")).alias("line"))


def retrieve(nodes: DataFrame, edges: DataFrame, query: list[float], top_k: int = TOP_NODES, top_k_edges: int = TOP_EDGES, hops: int = HOPS) -> str:
    """Context of a query vector: lines around the closest nodes, then those of the closest edges (may repeat)."""
    hits = search.top_k(nodes.where("embedding IS NOT NULL").select("id", "embedding", "ord"), query, top_k)
    ranked = [(r.id, i) for i, r in enumerate(hits.collect())]  # top_k rows
    spark = nodes.sparkSession
    lines: list[str] = []
    if ranked:
        seeds = spark.createDataFrame(ranked, "id string, seed_ord int")
        lines += [r.line for r in ego_context(nodes, edges, seeds, hops).orderBy("seed_rank", "source_id", "target_id").toLocalIterator()]
    if "embedding" in edges.columns and top_k_edges:
        lines += [r.line for r in edge_lines(nodes, edges, query, top_k_edges).orderBy(F.desc("score"), F.desc("ord")).collect()]  # top_k_edges rows
    return "\n".join(lines) or NOTHING


def answer(question: str, context: str, client: Client | None = None) -> dict:
    """Prompt and, with a client, the reply; an error becomes the reply's text."""
    from .prompts import _ASK

    text = f"{_ASK['answer']}\n\n### CONTEXT\n{context}\n\n### TEXT\n{question}"
    out = {"query": question, "context": context, "prompt": text, "answer": None}
    if client is not None:
        try:
            out["answer"] = client.complete(text, {"stage": "answer", "temperature": 0.7, "max_tokens": 1024})[0]
        except Exception as e:  # noqa: BLE001  shown to the asker
            out["answer"] = f"Error: {e}"
    return out


def answer_query(nodes: DataFrame, edges: DataFrame, question: str, embedder: search.Embedder, client: Client | None = None, **how) -> dict:
    """Retrieve for a question and answer it; without a client the prompt alone."""
    vector = [float(x) for x in embedder.embed([question])[0]]
    return answer(question, retrieve(nodes, edges, vector, **how), client)


def append_history(history: DataFrame, turn: dict) -> DataFrame:
    """history (query, answer, context, prompt, n_prompt, n_context) with one turn more."""
    row = history.sparkSession.createDataFrame([(turn["query"], turn["answer"], turn["context"], turn["prompt"], len(turn["prompt"]), len(turn["context"]))], "query string, answer string, context string, prompt string, n_prompt int, n_context int")
    return history.unionByName(row)


def document_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, sources and languages as a graph: part_of, written_in, covers."""
    d = documents.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("doc"), F.col("doc_id"), F.concat(F.lit("src:"), F.col("source")).alias("src"), F.col("source"), F.concat(F.lit("lang:"), F.col("lang")).alias("lng"), F.col("lang"))
    nodes = d.select(F.col("doc").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("label"), F.col("lang").alias("type"))
    nodes = nodes.unionByName(d.select(F.col("src").alias("id"), F.col("source").alias("label"), F.lit("source").alias("type")).distinct())
    nodes = nodes.unionByName(d.select(F.col("lng").alias("id"), F.col("lang").alias("label"), F.lit("lang").alias("type")).distinct())
    edge = lambda a, r, b: d.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(r).alias("relation"), F.lit("").alias("desc"))
    return nodes, edge("doc", "part_of", "src").unionByName(edge("doc", "written_in", "lng")).unionByName(edge("src", "covers", "lng").distinct())


def flagship(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Context lines around the three documents whose vectors are closest to vector 0."""
    query = embeddings.where("vec_id = 0").select("embedding").first()
    nodes, edges = document_graph(documents)
    ids = documents.select("doc_id")
    candidates = embeddings.where("vec_id <> 0").join(ids, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.concat(F.lit("doc:"), F.col("vec_id")).alias("id"), "embedding", F.col("vec_id").alias("ord"))
    hits = search.top_k(candidates, list(query[0]) if query else [], TOP_NODES)
    from pyspark.sql.window import Window

    seeds = hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("ord"))).alias("seed_ord"))  # three rows
    return ego_context(nodes, edges, seeds)
