"""Entity and event graphs (GRA-4..6, FLT-11..17, AGG-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph


def event_edges(events: DataFrame) -> DataFrame:
    """source, target, relation, desc of events (id, type, participants, location, description)."""
    who = events.select("id", "type", F.explode("participants").alias("target")).where(~T.is_blank(F.col("target")))
    who = who.select(F.col("id").alias("source"), "target", F.lit("has_participant").alias("relation"), F.concat(F.lit("Participant in "), F.col("type")).alias("desc"))
    where = events.where(~T.is_blank(F.col("location")))
    text = F.when(T.is_blank(F.col("description")), F.concat(F.col("type"), F.lit(" at this location"))).otherwise(F.col("description"))
    where = where.select(F.col("id").alias("source"), F.col("location").alias("target"), F.lit("occurs_at").alias("relation"), text.alias("desc"))
    return who.unionByName(where)


def connected_events(events: DataFrame) -> DataFrame:
    """Events with a participant or a location."""
    return events.where(F.exists(F.coalesce("participants", F.array()), lambda p: ~T.is_blank(p)) | ~T.is_blank(F.col("location")))


def entity_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    entities = nodes.where("node_type = 'entity'")
    return entities, graph.induced(entities, edges)


def meaningful(nodes: DataFrame) -> DataFrame:
    return nodes.where(~T.is_meaningless(F.col("id"), F.col("label")))


def flagged(nodes: DataFrame) -> DataFrame:
    """Nodes with is_generic for creatures and invalid_reason."""
    generic = F.when(F.col("type") == "Creature", T.is_generic_creature(F.col("label"))).otherwise(False)
    return nodes.withColumns({"is_generic": generic, "invalid_reason": T.invalid_reason(F.col("id"), F.col("node_type"), F.col("type"))})


def assemble(entities: DataFrame, events: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """De-duplicate, filter, remap, add the events' edges, drop dangling edges, flag invalid rows."""
    kept = graph.longest_label(meaningful(entities))
    linked = graph.mapped_array(graph.mapped(events, "location", mapping), "participants", mapping, ["id"])
    linked = connected_events(linked)
    columns = ["id", "label", "type", "ord"]
    nodes = kept.select(*columns, F.lit("entity").alias("node_type")).unionByName(linked.select(*columns, F.lit("event").alias("node_type")))
    moved = graph.mapped(graph.mapped(relations, "source", mapping), "target", mapping).where("source <> target")
    both = moved.select("source", "target", "relation", "desc").unionByName(event_edges(linked))
    edges = graph.unique_edges(both.withColumn("ord", F.xxhash64("source", "target", "relation", "desc")))
    return flagged(nodes), graph.induced(nodes, edges)


def known_entities(nodes: DataFrame, n: int = 20) -> DataFrame:
    """Per type the first n entities as lines `[id] label (type)`."""
    top = graph.first_n(nodes, ["type"], n)
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("label"), F.lit(" ("), F.col("type"), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("type").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n"))


def entity_lookup(nodes: DataFrame) -> DataFrame:
    """key, id: by id, label and name, a later entry winning."""
    keys = nodes.select("id", F.col("ord"), F.explode(F.array("id", "label", *(["name"] if "name" in nodes.columns else []))).alias("key"))
    return graph.last_wins(keys.where(~T.is_blank(F.col("key"))), ["key"]).select("key", "id")


def suggestions(nodes: DataFrame) -> DataFrame:
    """Labels to offer in a search, sorted."""
    return nodes.where(~T.is_blank(F.col("label"))).select("label").distinct().orderBy("label")


def eligible_sections(sections: DataFrame, locations: DataFrame) -> DataFrame:
    """Sections with content and links or mapped locations; their locations as an array, empty if none."""
    mapped = locations.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "location_id"))), lambda s: s["location_id"]).alias("location_ids"))
    out = sections.join(mapped, "section_id", "left").withColumn("location_ids", F.coalesce("location_ids", F.array().cast("array<string>")))
    return out.where(~T.is_blank(F.col("content")) & ((F.size("links") > 0) | (F.size("location_ids") > 0)))


def valid_locations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Answers (section_id, location_ids) restricted to known ids (id), order and repeats kept."""
    each = answers.select("section_id", F.posexplode("location_ids").alias("ord", "id")).join(known.select("id").distinct(), "id", "left_semi")
    return each.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("location_ids"))


def relations_like(edges: DataFrame, pattern: str) -> DataFrame:
    return edges.where(F.col("relation").rlike(pattern))
