"""Model-backed stages as maps around calls (LLM-1..11, 15)."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LLM_CALLS
from ..operators import canonical, graph, hetero, parsers, ranks, traverse
from ..session import materialise
from .client import Client, Known, attempt, call, prompt_hash
from .ledger import Ledger, in_steps
from .prompts import UNIFIED, prompt

#: Known entities of each type that a prompt shows.
KNOWN = 20

_GRAPH = "struct<nodes: array<struct<id: string, label: string, type: string>>, edges: array<struct<source: string, target: string, relationship: string, relation: string, desc: string>>>"


def _path_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat_ws("/", "doc_id", F.array_join(F.transform("path", lambda i: i.cast("string")), ".")))


def summarise(nodes: DataFrame, client: Client) -> DataFrame:
    """doc_id, path, summary, level by level from the leaves; a failed or blank answer counts as the sentinel."""

    def answer(level: DataFrame) -> DataFrame:
        keyed = _path_key(level)
        calls = call(keyed.select("key", prompt("summary", F.col("content"), title=F.col("title"), below=F.col("below")).alias("prompt")), client, "summary", temperature=0.3)
        return keyed.join(calls.select("key", T.strip_thinking(F.col("response")).alias("answer")), "key", "left").drop("key")

    return traverse.roll_up(nodes, answer)


def extract_graphs(sections: DataFrame, client: Client, stage: str = "graph") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of sections (key, text, ord), and the replies that hold no graph (bad rows)."""
    calls = call(sections.select("key", prompt(stage, F.col("text")).alias("prompt")), client, stage, temperature=0.1)
    g = calls.withColumn("g", F.from_json(F.coalesce(T.salvage_json(T.strip_thinking(F.col("response"))), F.lit("{}")), _GRAPH)).join(sections.select("key", F.col("ord").alias("s")), "key")
    bad = g.where((F.col("status") != "ok") | F.col("g.nodes").isNull()).select("key", "status", "error", "response")
    place = lambda i: (F.col("s") * (1 << 20) + F.col(i)).alias("ord")
    nodes = g.select("key", "s", F.posexplode("g.nodes").alias("i", "n")).where(~T.is_blank(F.col("n.id"))).select("n.id", F.coalesce("n.label", "n.id").alias("label"), F.coalesce("n.type", F.lit("unknown")).alias("type"), place("i"))
    edges = g.select("key", "s", F.posexplode("g.edges").alias("i", "e")).where(~T.is_blank(F.col("e.source")) & ~T.is_blank(F.col("e.target"))).select("e.source", "e.target", F.coalesce("e.relationship", "e.relation", F.lit("")).alias("relation"), "e.desc", place("i"))
    return nodes, edges, bad


def resolve_duplicates(nodes: DataFrame, client: Client) -> DataFrame:
    """old_id, new_id that the model names; one call over the node lines, none on failure."""
    lines = nodes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", T.node_line(F.col("label"), F.col("id"), F.col("type")).alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    calls = call(lines.select(F.lit("all").alias("key"), prompt("resolve", F.col("text")).alias("prompt")), client, "resolve")
    answer = T.strip_thinking(F.coalesce("response", F.lit("{}")))
    pairs = calls.select(F.explode(F.coalesce(F.from_json(T.salvage_json(answer), "map<string, string>"), parsers.resolution_map(answer))).alias("old_id", "new_id"))
    return pairs.where("old_id <> new_id")


def chapter_graph(summaries: DataFrame, client: Client) -> tuple[DataFrame, DataFrame]:
    """Graphs of root sections (key, text, ord) merged: union, duplicates resolved, remapped, de-duplicated."""
    nodes, edges, _ = extract_graphs(summaries, client)
    nodes, edges = materialise(nodes, "nodes"), materialise(edges, "edges")
    mapping = materialise(resolve_duplicates(graph.upgraded_label(nodes), client), "mapping")
    moved = graph.mapped(graph.mapped(edges, "source", mapping), "target", mapping).where("source <> target")
    return graph.upgraded_label(graph.mapped(nodes, "id", mapping)), graph.unique_edges(moved)


def map_sections(sections: DataFrame, locations: DataFrame, client: Client) -> DataFrame:
    """section_id, location_id, ord: the model's answers among the known locations; failures have none."""
    known = locations.agg(F.array_join(F.array_sort(F.collect_list(T.node_line(F.col("label"), F.col("id"), F.col("type")))), "\n").alias("known"))
    asked = sections.join(F.broadcast(known)).select(F.col("section_id").alias("key"), prompt("locations", F.col("text"), known=F.col("known")).alias("prompt"))  # one row
    calls = call(asked, client, "locations")
    answers = calls.where("status = 'ok'").select(F.col("key").alias("section_id"), parsers.location_ids(F.coalesce(T.salvage_json(T.strip_thinking(F.col("response"))), F.lit("{}"))).alias("location_ids"))
    valid = hetero.valid_locations(answers, locations)
    return valid.select("section_id", F.posexplode("location_ids").alias("ord", "location_id"))


def enrich(sections: DataFrame, section_locations: DataFrame, client: Client) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity graphs of the eligible sections (section_id, content, links, ord)."""
    fit = hetero.eligible_sections(sections, section_locations)
    text = F.concat_ws("\n", F.concat(F.lit("Places: "), F.array_join("location_ids", ", ")), "content")
    return extract_graphs(fit.select(F.col("section_id").alias("key"), text.alias("text"), "ord"), client, "entities")


def sub_locations(parents: DataFrame, client: Client, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A further pass below the given places (key, text, ord): only nodes and edges that are new."""
    nodes, edges, _ = extract_graphs(parents, client)
    return graph.only_new(known, nodes, ["id"]), graph.unique_edges(edges)


def verify(graphs: DataFrame, client: Client) -> DataFrame:
    """key and the verification report of graphs (key, text)."""
    calls = call(graphs.select("key", prompt("verify", F.col("text")).alias("prompt")), client, "verify")
    return calls.select("key", parsers.report("response").alias("report")).select("key", "report.*")


def recognise(nodes: DataFrame, client: Client, least: int = 50, most: int = 2000) -> DataFrame:
    """Entities of sections (key, content): short ones skipped, long ones shortened for the prompt."""
    some = nodes.where(F.length("content") >= least)
    calls = call(some.select("key", prompt("ner", T.truncated(F.col("content"), most)).alias("prompt")), client, "ner", temperature=0.9, top_p=0.95)
    return calls.select("key", F.posexplode(parsers.entities(T.strip_thinking(F.coalesce("response", F.lit(""))))).alias("i", "e")).select("key", "i", "e.*")


def extract_in_order(nodes: DataFrame, client: Client, seeds: list[tuple[str, str, str]] = (), ledger: Ledger | None = None) -> DataFrame:
    """Entities and events section by section in document order, each call knowing what came before.

    `seeds` (id, label, type) are known from the start; of each type the first KNOWN are shown. The
    order is the semantics, so a document is one task; documents run beside each other. A section whose call
    failed has neither; the call's row (`call`, see sequential_calls) tells why. With a ledger the sections go a step
    at a time, and a run that was killed goes on behind the last step that it committed.
    """
    if (own := getattr(client, "ledger", None)) is not None:
        client, ledger = client.client, ledger or own
    row = LLM_CALLS.replace(" string", ": string")
    fields = f"doc_id string, path array<int>, entities array<{parsers.ENTITY}>, events array<{parsers.EVENT}>, call struct<{row}>"

    def run(pdf: pd.DataFrame, replies: dict[str, tuple[str, str]] | None = None) -> pd.DataFrame:
        known: dict[str, dict[str, str]] = {}
        out = []

        def learn(id: str, label: str, type: str) -> None:
            known.setdefault(type, {}).setdefault(id, label)

        for s in seeds:
            learn(*s)
        for r in pdf.sort_values("path", key=lambda s: s.map(tuple)).itertuples():
            lines = [x for t, of in known.items() for x in (f"{t}:", *(f"  - [{i}] {label}" for i, label in list(of.items())[:KNOWN]))]
            before = "### KNOWN\n" + "\n".join(lines) + "\n\n" if lines else ""
            key = f"{r.doc_id}/{'.'.join(map(str, r.path))}"
            text = f"{UNIFIED}\n\n{before}### TEXT\n{r.content or ''}"
            told = (replies or {}).get(prompt_hash(text, "events"))
            made = attempt(client if told is None else Known(told), key, text, "events", temperature=0.75)
            reply = made["response"] or ""
            entities, events = parsers.parse_entities(reply) if "<entities>" in reply else [], parsers.parse_events(reply)
            for e in entities:
                learn(e["id"], e["label"], e["type"])
            out.append((r.doc_id, list(r.path), entities, events, made))
        return pd.DataFrame(out, columns=["doc_id", "path", "entities", "events", "call"])

    sections = nodes.select("doc_id", "path", "content")
    if ledger is not None:
        return in_steps(ledger, "events", sections, run, fields)
    return sections.groupBy("doc_id").applyInPandas(lambda pdf: run(pdf), fields)


def sequential_calls(extracted: DataFrame) -> DataFrame:
    """The call of each section of extract_in_order(): prompt, reply, status, error and finish reason."""
    return extracted.select("call.*")


def in_document_order(rows: DataFrame, *place: str, after: int = 0) -> DataFrame:
    """rows with ord, their place when ordered by document, path and what stands within it."""
    return ranks.numbered(rows.orderBy("doc_id", "path", *place), "ord").withColumn("ord", F.col("ord") + after)


def relate(sections: DataFrame, aliases: DataFrame, client: Client, stage: str = "relations") -> DataFrame:
    """Relations of sections that mention two known entities or more; the first of each key holds.

    The stage `hierarchy`, with the aliases of places, asks for the places that lie in others.
    """
    named = canonical.mentions(sections, aliases, least=2)
    asked = sections.join(named, "section_id").select(F.col("section_id").alias("key"), prompt(stage, F.col("content"), known=F.array_join("ids", ", ")).alias("prompt"))
    calls = call(asked, client, stage)
    each = calls.select("key", F.posexplode(parsers.relations(T.strip_thinking(F.coalesce("response", F.lit(""))))).alias("i", "r")).select("key", "i", "r.*")
    return graph.first_wins(each.withColumn("ord", F.struct("key", "i")), graph.EDGE_KEY)


def resolve_groups(entities: DataFrame, client: Client, least: int = 10) -> DataFrame:
    """Entities of groups (group, id, label, type, ord): more than `least` ids are put to the model, else ids are de-duplicated."""
    size = entities.groupBy("group").agg(F.count_distinct("id").alias("n"))
    big = entities.join(size.where(F.col("n") > least), "group", "left_semi")
    lines = big.groupBy(F.col("group").alias("key")).agg(F.array_join(F.array_sort(F.collect_set(T.node_line(F.col("label"), F.col("id"), F.col("type")))), "\n").alias("text"))
    calls = call(lines.select("key", prompt("resolve", F.col("text")).alias("prompt")), client, "resolve")
    mapping = calls.where("response IS NOT NULL").select(F.col("key").alias("group"), F.explode(parsers.resolution_map(F.col("response"))).alias("id", "new_id"))
    moved = entities.join(mapping, ["group", "id"], "left").withColumn("id", F.coalesce("new_id", "id")).drop("new_id")
    return graph.longest_label(moved, ["group", "id"])


def two_phase(sections: DataFrame, client: Client) -> tuple[DataFrame, DataFrame]:
    """Recognise entities of sections (section_id, content), resolve them, then relate those that are mentioned together.

    The first of several equal entities holds, in the order of the sections' ord where they have one, else of their ids.
    """
    found = recognise(sections.select(F.col("section_id").alias("key"), "content"), client)
    if "ord" in sections.columns:
        found = found.join(sections.select(F.col("section_id").alias("key"), F.col("ord").alias("at")), "key")
    else:
        found = found.withColumn("at", F.col("key"))
    found = ranks.numbered(found.orderBy("at", "key", "i"), "ord").select(F.col("type").alias("group"), "id", "label", "type", "aliases", "ord")
    kept = graph.first_wins(resolve_groups(found, client), ["id"])
    nodes = materialise(hetero.meaningful(kept), "nodes")
    edges = relate(sections, canonical.alias_map(nodes), client)
    return nodes, graph.induced(nodes, edges)


def semantic(docs: DataFrame, catalogs: dict[str, DataFrame], client: Client) -> dict[str, DataFrame]:
    """Parse, resolve, seed, extract in order, place in hierarchies, relate, assemble: tables sections, references, entities, nodes, edges, calls, stats.

    Seeds stand in the order of their first references, before all that sections tell, which comes in document order.
    """
    from ..operators import flatten, resolve, stats

    sections = materialise(flatten.flatten(docs, "indexed"), "sections")
    refs = materialise(flatten.external_refs(sections), "references")
    entities = materialise(resolve.resolve_all(refs, catalogs), "entities")
    none = F.array().cast("array<string>")
    first = ranks.numbered(refs.orderBy("doc_id", "path", "link_ord"), "at").groupBy(F.col("display_name").alias("label")).agg(F.min("at").alias("at"))
    seeds = resolve.seeds(entities).join(first, "label", "left").select("id", "label", "type", none.alias("aliases"), "at")
    own = ranks.numbered(seeds.orderBy("at", "id", "type"), "ord").drop("at")
    shown = graph.first_n(own, ["type"], KNOWN).orderBy("type", "rank").collect()  # KNOWN rows a type
    extracted = materialise(extract_in_order(sections, client, [(r.id, r.label, r.type) for r in shown]), "extracted")
    new = in_document_order(extracted.select("doc_id", "path", F.posexplode("entities").alias("i", "e")), "i", after=own.count()).select("e.id", "e.label", "e.type", F.coalesce("e.aliases", none).alias("aliases"), "ord")
    events = in_document_order(extracted.select("doc_id", "path", F.posexplode("events").alias("i", "e")), "i").select("e.id", "e.label", "e.type", "e.participants", "e.location", "e.description", "ord")
    every = materialise(own.unionByName(new), "every-entity")
    texts = _path_key(sections).select(F.col("key").alias("section_id"), "content")
    inside = relate(texts, canonical.alias_map(hetero.meaningful(every).where("type = 'Location'")), client, "hierarchy")
    meant = relate(texts, canonical.alias_map(hetero.meaningful(every)), client)
    ends = ("source", "target", "relation", "desc")
    relations = materialise(inside.select(*ends).unionByName(meant.select(*ends)), "relations")
    known = canonical.canonical_ids(every.select("id", "label", "aliases"), every).select("old_id", "new_id")
    nodes, edges = hetero.assemble(every, events, relations, known)
    return {"sections": sections, "references": refs, "entities": entities, "nodes": nodes, "edges": edges, "calls": sequential_calls(extracted), "stats": stats.graph_totals(nodes, edges)}


def explain_extraction(node: str, client: Client) -> dict:
    """Prompt, reply and parsed entities of one text."""
    reply, why = client.complete(f"### TEXT\n{node}", {"stage": "ner"})
    return {"reply": reply, "finish_reason": why, "entities": parsers.parse_entities(reply)}


