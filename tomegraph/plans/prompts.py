"""Prompts of the stages: what is asked, and the form of the reply (LLM-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASK = {
    "summary": "Say in a few sentences which places the text describes and how they lie to each other. If it describes none, answer NO_SPATIAL_INFO.",
    "graph": 'Write the places and their relations as JSON: {"nodes": [{"id", "label", "type"}], "edges": [{"source", "target", "relationship", "desc"}]}. Ids are snake_case.',
    "resolve": "Some ids below name the same thing. Answer a JSON object from each duplicate id to the id to keep, {} if none.",
    "locations": 'Which of the known places does the section happen at? Answer JSON {"location_ids": [ids]}.',
    "entities": 'Add the creatures, items and characters of the section to the known places, as JSON {"nodes": [...], "edges": [...]}, with ids in snake_case.',
    "ner": "List the entities of the text between <entities> and </entities>, one per block of lines Entity, Type, ID, LocationType, CreatureType, IsGeneric, Aliases. If there are none, say so between <summary> and </summary>.",
    "events": "List the events of the text between <events> and </events>, one per block of lines Event, Type, ID, Participants, Location, Description.",
    "relations": "List relations between the known entities as blocks of lines Source, Relation, Target, Description, with a blank line between blocks.",
    "hierarchy": "Say which of the known places lies in which, as blocks of lines Relation: part_of, Source (the inner place), Target (the outer place), Description, with a blank line between blocks.",
    "verify": "Check the list of places against the text. Answer lines `Is Complete: Yes or No`, `Missing Locations:` and `Issues:`, items as lines that start with a hyphen.",
    "answer": "Answer the question from the context alone. If the context doesn't tell, say so.",
}


#: Entities and events of one call.
UNIFIED = f"{_ASK['ner']}\n{_ASK['events']}"


def prompt(stage: str, text: Column, **parts: Column) -> Column:
    """The task, named parts that aren't blank, then the text."""
    out = [F.lit(_ASK[stage] + "\n\n")]
    for name, value in parts.items():
        out.append(F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(f"### {name.upper()}\n"), value, F.lit("\n\n"))).otherwise(""))
    return F.concat(*out, F.lit("### TEXT\n"), F.coalesce(text, F.lit("")))
