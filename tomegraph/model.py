"""Schemas of the engine's tables. Every table carries an ordinal, for order is part of the data."""

LINK = "struct<text: string, tag: string, attrs: array<string>>"
DOC_NODES = f"doc_id string, path array<int>, parent_path array<int>, depth int, node_id string, title string, type string, content string, links array<{LINK}>"
NODES = "graph_id string, id string, label string, type string, ord long"
EDGES = "graph_id string, source string, target string, relation string, desc string, ord long"
SECTION_LOCATIONS = "section_id string, location_id string, ord long"
MAPPING = "old_id string, new_id string"
LLM_CALLS = "prompt_hash string, stage string, key string, prompt string, response string, status string, error string, finish_reason string"

#: Types whose entries open a section of their own.
STRUCTURAL_TYPES = ("section", "entries", "inset", "insetReadaloud")
#: Node and event types that validation accepts.
ENTITY_TYPES = ("Location", "Creature", "Item", "Group")
EVENT_TYPES = ("encounter", "combat", "discovery", "dialogue", "exploration", "observation", "quest", "trap", "puzzle", "social_challenge")
#: Fixed value: what a summary says that found no places.
NO_SPATIAL_INFO = "NO_SPATIAL_INFO"
