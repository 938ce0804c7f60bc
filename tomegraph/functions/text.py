"""Names, ids and small formats as column expressions (FN-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation names with a fixed upper-case form, and node types with a label.
RELATIONS = ("part_of", "contains", "inhabits", "explores", "knows", "guards", "found_in", "drops", "uses", "located_at")
TYPE_LABELS = {"creature": "Creature", "item": "Item", "spell": "Spell", "location": "Location", "party": "Party", "unknown": "Entity"}
#: Stems of generic creature labels.
GENERIC_STEMS = ("zombie", "skeleton", "goblin", "kobold", "orc", "bandit", "guard", "cultist", "warrior", "soldier", "merchant", "villager", "commoner", "pirate", "sailor", "dragon")
#: Ids and labels that stand for nothing in particular.
NUMBERED_IDS = r"^((adventure_location|location|loc|zone|region|section)_?\d+|area(_[a-z])?\d+)$"
CATEGORY_IDS = ("adventure_locations", "unknown_entities", "unknown_locations", "generic_entities", "miscellaneous_entities", "other_entities", "various_locations", "several_locations", "multiple_entities")
PLACEHOLDER_IDS = r"^(entity|node|object|item|thing|placeholder|temp|unknown)_\d+$"
GENERIC_LABELS = r"^(an? (area|location|place|spot|region|zone)|(unknown|generic|unspecified|unnamed) (area|location|place|entity|object))$"


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def suggested_id(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def snake_id(c: Column) -> Column:
    """Lower case, blanks and hyphens to underscores, everything but letters and digits dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[ \-]", "_"), r"[^\p{L}\p{N}_]", "")


def slug(c: Column) -> Column:
    """Runs outside a-z and 0-9 to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def default_id(label: Column) -> Column:
    return F.regexp_replace(suggested_id(label), "'", "")


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small rest, whatever stands between the runs."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def default_label(label: Column, aliases: Column, node_id: Column) -> Column:
    alias = F.regexp_replace(F.get(aliases, 0), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.when(~is_blank(label), F.trim(label)), F.when(F.size(aliases) > 0, alias), title_case(F.replace(node_id, F.lit("_"), F.lit(" "))))


def normalized_label(c: Column) -> Column:
    """Underscores to blanks, lower case, one blank for white space, quotes dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), "['`]", ""), r"(?U)\s+", " "))


def normalized_name(c: Column, underscores: bool = False) -> Column:
    """Evaluation form; `underscores` takes them for blanks as well."""
    c = F.replace(c, F.lit("_"), F.lit(" ")) if underscores else c
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['\"`]", ""), r"(?U)\s+", " ")), F.lit(""))


def alias_forms(label: Column) -> Column:
    """The normalised label and each pair of neighbouring words in it."""
    name = F.replace(F.lower(label), F.lit("_"), F.lit(" "))
    words = F.filter(F.split(name, " "), lambda w: w != "")
    pairs = F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(name), pairs))


def md5_id(prefix: str | Column, name: Column, source: Column) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.md5(F.lower(F.concat_ws(":", prefix, F.trim(name), F.trim(F.coalesce(source, F.lit("unknown"))))).cast("binary"))


def relation_type(c: Column) -> Column:
    """Upper case with underscores; the fixed relations have that form already."""
    return F.when(F.lower(c).isin(*RELATIONS), F.upper(c)).otherwise(F.translate(F.upper(c), " -", "__"))


def type_label(c: Column) -> Column:
    out = F.lit("Entity")
    for k, v in TYPE_LABELS.items():
        out = F.when(F.lower(c) == k, v).otherwise(out)
    return out


def is_generic_creature(label: Column) -> Column:
    name = F.trim(F.lower(label))
    return F.coalesce(name.rlike("^(" + "|".join(GENERIC_STEMS) + ")") | (name.endswith("s") & (F.length(name) > 4)), F.lit(False))


def is_meaningless(node_id: Column, label: Column) -> Column:
    i, name = F.lower(F.coalesce(node_id, F.lit(""))), F.trim(F.lower(F.coalesce(label, F.lit(""))))
    return i.rlike(NUMBERED_IDS) | i.isin(*CATEGORY_IDS) | i.rlike(PLACEHOLDER_IDS) | name.rlike(GENERIC_LABELS)


def invalid_reason(node_id: Column, kind: Column, node_type: Column) -> Column:
    """Null for valid nodes: snake-case id, known type for its kind."""
    from ..model import ENTITY_TYPES, EVENT_TYPES

    return (
        F.when(is_blank(node_id), "empty id")
        .when(~node_id.rlike(r"^[\p{Ll}\p{N}_]+$"), "id is not snake case")
        .when((kind == "entity") & ~F.coalesce(node_type.isin(*ENTITY_TYPES), F.lit(False)), "unknown entity type")
        .when((kind == "event") & ~F.coalesce(node_type.isin(*EVENT_TYPES), F.lit(False)), "unknown event type")
    )


def strip_thinking(c: Column) -> Column:
    """Text without <think> blocks; the original where a block stays open or nothing else is left."""
    rest = F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    return F.when(F.contains(rest, F.lit("<think>")) | (rest == ""), c).otherwise(rest)


def salvage_json(c: Column) -> Column:
    """First parseable JSON in a reply: fenced blocks, then the widest braces; null if none."""
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    wide = F.regexp_extract_all(c, F.lit(r"(?s)\{.*\}"), F.lit(0))
    return F.get(F.filter(F.concat(fenced, wide), lambda x: F.try_parse_json(x).isNotNull()), 0)


def truncated(c: Column, limit: int, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def node_line(label: Column, node_id: Column, node_type: Column) -> Column:
    return F.concat(F.lit("- "), label, F.lit(" (ID: "), node_id, F.lit(", Type: "), node_type, F.lit(")"))


def edge_line(source: Column, relation: Column, target: Column, desc: Column | None = None) -> Column:
    """`- S --[rel]--> T (desc)`, the last part only for a desc that isn't blank."""
    head = F.concat(F.lit("- "), source, F.lit(" --["), F.coalesce(relation, F.lit("")), F.lit("]--> "), target)
    return head if desc is None else F.concat(head, F.when(is_blank(desc), "").otherwise(F.concat(F.lit(" ("), desc, F.lit(")"))))


def section_block(node_id: Column, parent: Column, title: Column, content: Column, children: Column) -> Column:
    kids = F.when(F.coalesce(F.size(children), F.lit(0)) > 0, F.array_join(children, ", ")).otherwise("None")
    return F.concat(F.lit("ID: "), node_id, F.lit("\nParent Title: "), F.coalesce(parent, F.lit("None")), F.lit("\nTitle: "), title, F.lit("\nContent: "), content, F.lit("\nChild Titles: "), kids)


def area_code(title: Column) -> Column:
    """The code of titles such as `A1: Name`, `b2 Name` or `Area C3:Name`; empty where there is none."""
    return F.regexp_extract(title, r"(?iU)^(?:area\s+)?([a-z][0-9]+)[:\s]\s*[^\n]+$", 1)


def node_size(degree: Column) -> Column:
    return 25 + F.least(degree * 3, F.lit(60))


def display_label(label: Column, size: Column) -> Column:
    limit = F.greatest(F.lit(4), F.floor(size / 3.5).cast("int"))
    return F.when(F.length(label) > limit, F.concat(F.substr(label, F.lit(1), limit), F.lit(".."))).otherwise(label)


def edge_width(weight: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), F.least(weight.cast("double"), F.lit(10.0))), F.lit(1.0))


#: Node colours by the first type name contained, and the default.
COLOURS = (("Location", "#f1b8f1"), ("Monster", "#d9b8f1"), ("Npc", "#f1ccb8"), ("Player", "#f1f1b8"), ("Item", "#b8f1ed"), ("Event", "#b8f1cc"))
DEFAULT_COLOUR, DIM_COLOUR = "#34CAF7", "rgba(50, 50, 50, 0.1)"


def node_colour(node_type: Column) -> Column:
    name, out = title_case(node_type), F.lit(DEFAULT_COLOUR)
    for part, colour in reversed(COLOURS):
        out = F.when(F.contains(name, F.lit(part)), colour).otherwise(out)
    return out


def html_escape(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


#: Words that tell a label's kind; the first kind with a word in the label holds.
LABEL_WORDS = {
    "creatures": ("dragon", "zombie", "kobold", "harpy", "ghoul", "owlbear", "fungi", "stirge", "snake", "spore", "servant", "octopus", "sailor", "sharruth", "runara", "agga", "blepp", "frub", "kilnip", "laylee", "mumpo", "myla", "rix", "zark", "tarak", "varnoth", "aidron", "sinensa", "bispo", "valup", "popple", "orcus", "tides", "renegade"),
    "locations": ("rest", "house", "kitchen", "library", "temple", "cave", "tunnel", "farm", "chamber", "larder", "deck", "nest", "castle", "quarters", "hall", "hold", "observatory", "anchor", "camp", "study", "tower", "entrance", "isle"),
    "items": ("treasure", "sculpture", "effigie", "crystal", "bridge"),
}


def label_kind(label: Column) -> Column:
    out = F.lit("unknown")
    for kind, words in reversed(LABEL_WORDS.items()):
        out = F.when(F.lower(label).rlike("|".join(words)), kind).otherwise(out)
    return out
