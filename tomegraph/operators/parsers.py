"""Text protocols of model replies (PAR-1..7)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<id: string, label: string, type: string, aliases: array<string>, location_type: string, creature_type: string, is_generic: boolean>"
EVENT = "struct<id: string, label: string, type: string, participants: array<string>, location: string, description: string>"
REPORT = "struct<is_complete: boolean, missing_locations: array<string>, issues: array<string>>"
_TRUE = ("true", "yes", "1")


def _items(value: str, brackets: str) -> list[str]:
    value = value.strip()
    if value[:1] in brackets[0::2]:
        value = value[1:]
    if value[-1:] in brackets[1::2]:
        value = value[:-1]
    return [x for x in (p.strip() for p in value.split(",")) if x]


def _records(body: str, opener: str) -> list[dict[str, str]]:
    """`key: value` lines, a new record at each opener; a later key of a record wins."""
    out: list[dict[str, str]] = []
    for line in body.splitlines():
        key, colon, value = line.strip().partition(":")
        if not colon:
            continue
        key = key.strip().lower()
        if key == opener or not out:
            out.append({})
        out[-1][key] = value.strip()
    return out


def _block(text: str, tag: str, open_end: bool = False) -> str | None:
    m = re.search(rf"<{tag}>(.*?)(?:</{tag}>{'|$' if open_end else ''})", text, re.DOTALL)
    return m[1] if m else None


def parse_entities(text: str) -> list[dict]:
    if not text or _block(text, "summary") is not None:
        return []
    body = _block(text, "entities")
    out = []
    for r in _records(text if body is None else body, "entity"):
        aliases = _items(r.get("aliases", ""), "[]")
        label, own = r.get("entity", ""), r.get("id", "")
        if not label and not own:
            continue
        label = label or (aliases[0].strip("\"'") if aliases else "") or own.replace("_", " ").title()
        out.append({"id": own or label.lower().replace(" ", "_").replace("'", ""), "label": label, "type": r.get("type", "Entity"), "aliases": aliases, "location_type": r.get("locationtype"), "creature_type": r.get("creaturetype"), "is_generic": r.get("isgeneric", "").lower() in _TRUE})
    return out


def parse_events(text: str) -> list[dict]:
    if not text:
        return []
    body = _block(text, "events", open_end=True)
    if body is None:
        body = text if re.search(r"(?im)^\s*event:", text) else ""
    out = []
    for r in _records(body, "event"):
        label = r.get("event", "")
        if not label and not r.get("id"):
            continue
        out.append({"id": r.get("id") or re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_"), "label": label or r["id"], "type": r.get("type", "encounter").lower(), "participants": _items(r.get("participants", ""), "[]()"), "location": r.get("location") or None, "description": r.get("description", "")})
    return out


def parse_unified(text: str) -> dict:
    """Entities and events of one reply; a summary means neither, an open events block counts."""
    if not text or _block(text, "summary") is not None:
        return {"entities": [], "events": []}
    head = text.partition("<events>")[0]
    return {"entities": parse_entities(head) if "<entities>" in text else [], "events": parse_events(text)}


def entity_udf():
    @F.pandas_udf(f"array<{ENTITY}>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: parse_entities(x or ""))

    return run


def event_udf():
    @F.pandas_udf(f"array<{EVENT}>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: parse_events(x or ""))

    return run


def unified(text: Column | str) -> Column:
    """struct<entities, events> of one reply."""

    @F.pandas_udf(f"struct<entities: array<{ENTITY}>, events: array<{EVENT}>>")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_unified(x or "") for x in text], columns=["entities", "events"])

    return run(text)


def entities(text: Column | str) -> Column:
    return entity_udf()(text)


def events(text: Column | str) -> Column:
    return event_udf()(text)


#: What makes a line of a report a heading, and of which part.
REPORT_HEADINGS = {"is_complete": "is complete|complete:", "missing_locations": "missing.*location|location.*missing", "issues": "issue"}


def report_sql(text: str) -> str:
    """A struct of REPORT from the SQL expression of a text.

    The text is cut before every heading, so a part is a heading and the lines that belong to it: its
    `-` lines are its items. A heading counts for the first kind in REPORT_HEADINGS that it fits, and the
    last heading on completeness decides.
    """
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    every = "|".join(REPORT_HEADINGS.values())
    parts = f"split(regexp_replace({text}, '\\\\R', '\\n'), {quoted(f'(?im)^(?=.*(?:{every}))')})"
    heading = lambda p: f"lower(substring_index({p}, '\\n', 1))"
    fits = lambda p, kind: f"rlike({heading(p)}, {quoted(REPORT_HEADINGS[kind])})"

    def of(kind: str) -> str:
        earlier = [k for k in REPORT_HEADINGS if list(REPORT_HEADINGS).index(k) < list(REPORT_HEADINGS).index(kind)]
        return f"filter({parts}, p -> {' AND '.join([fits('p', kind), *(f'NOT {fits("p", k)}' for k in earlier)])})"

    def items(kind: str) -> str:
        below = "substring(p, length(substring_index(p, '\\n', 1)) + 1)"
        found = f"regexp_extract_all({below}, {quoted('(?m)^[^\\S\\n]*-+(.*)$')}, 1)"
        return f"transform(flatten(transform({of(kind)}, p -> {found})), x -> trim(x))"

    complete = f"coalesce(rlike({heading(f'try_element_at({of("is_complete")}, -1)')}, 'yes|true'), false)"
    none = "cast(array() AS array<string>)"
    return f"named_struct('is_complete', {complete}, 'missing_locations', coalesce({items('missing_locations')}, {none}), 'issues', coalesce({items('issues')}, {none}))"


def report(text: str) -> Column:
    """struct of REPORT from a column of replies, by its name."""
    return F.expr(report_sql(f"`{text}`"))


def relations(text: Column) -> Column:
    """array<struct<source, target, relation, desc>> of blocks between blank lines; blocks lacking one of three are dropped."""
    body = F.coalesce(F.when(F.contains(text, F.lit("<relations>")), F.regexp_extract(text, r"(?s)<relations>(.*?)(?:</relations>|$)", 1)), text)
    blocks = F.split(body, r"\n\s*\n")

    def record(block: Column) -> Column:
        """The last value of each key: all lines before it are skipped as far as they go."""
        last = lambda key: F.trim(F.regexp_extract(block, rf"(?i)^(?s:.*\n)? *{key} *:([^\n]*)", 1))
        return F.struct(last("source").alias("source"), last("target").alias("target"), last("relation").alias("relation"), last("description").alias("desc"))

    return F.filter(F.transform(blocks, record), lambda r: (r["source"] != "") & (r["target"] != "") & (r["relation"] != ""))


def resolution_map(text: Column) -> Column:
    """map of `a -> b` or `a: b` lines; comments, blanks and identities are skipped, the last of a key wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    part = lambda x, i: F.trim(F.when(F.contains(x, F.lit("->")), F.get(F.split(x, "->", 2), i)).otherwise(F.get(F.split(x, ":", 2), i)))
    pairs = F.filter(F.transform(lines, lambda x: F.struct(part(x, 0).alias("key"), part(x, 1).alias("value"))), lambda p: p["value"].isNotNull() & (p["key"] != "") & (p["value"] != "") & (p["key"] != p["value"]))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def location_ids(text: Column) -> Column:
    """array<string> of a JSON answer: location_ids or location_id, a list, one string, or none."""
    v = F.try_parse_json(text)
    pick = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.array(F.try_variant_get(v, f"$.{k}", "string"))))
    return F.coalesce(pick("location_ids"), pick("location_id"), F.array().cast("array<string>"))
