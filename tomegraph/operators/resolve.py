"""References to catalog records, with properties and inheritance (JOIN-6..10, FN-14..19, PIPE-6, PIPE-7)."""

from __future__ import annotations

import contextlib
import functools
import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containment, text as T
from ..session import materialise
from . import chains

#: Keys that records lose, by kind.
DROPPED = ("otherSources", "variant", "environment", "traitTags", "senseTags", "actionTags", "languageTags", "damageTags", "damageTagsLegendary", "miscTags", "hasToken", "hasFluff", "hasFluffImages")
DROPPED_BY_KIND = {"creature": DROPPED, "item": (*DROPPED, "reqAttuneTags"), "spell": (*DROPPED, "classes", "classTags")}
#: Parents of parents that are followed.
MAX_DEPTH = 10


def _first(catalog: DataFrame, *keys: Column) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    return catalog.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min("ord").alias("hit"))


def match(refs: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """refs (ref_id, name, source) with tier and matched_ord of the catalog (ord, name, source), null if none.

    creature: name and source, name, name without case, one inside the other either way.
    item: the same, but only a reference inside a name. spell: name without case.
    Among equals the first of the catalog holds; only what equal names leave over goes to the substring join.
    """
    left = refs.withColumn("hit", F.lit(None).cast("long")).withColumn("tier", F.lit(None).cast("int"))

    def equal(df: DataFrame, tier: int, own: list[Column], theirs: list[Column]) -> DataFrame:
        keyed = _first(catalog, *theirs).withColumnRenamed("hit", "_hit")
        on = [a == F.col(f"k{i}") for i, a in enumerate(own)]
        out = df.join(keyed, on, "left")
        take = F.col("hit").isNull() & F.col("_hit").isNotNull()
        return out.withColumn("tier", F.when(take, tier).otherwise(F.col("tier"))).withColumn("hit", F.coalesce("hit", "_hit")).select(df.columns)

    name, source = F.col("name"), F.col("source")
    if kind != "spell":
        left = equal(left, 1, [name, source], [name, source])
        left = equal(left, 2, [name], [name])
    left = equal(left, 3, [F.lower("name")], [F.lower(name)])
    if kind != "spell":
        left = materialise(left, "matched")
        rest = left.where("hit IS NULL").select(F.lower("name").alias("t")).distinct()
        names = catalog.select(F.lower("name").alias("t")).distinct()
        inside = containment.contained(names.select(F.col("t").alias("hay_id"), F.col("t").alias("hay")), rest.select(F.col("t").alias("needle_id"), F.col("t").alias("needle"))).select(F.col("needle").alias("ref"), F.col("hay").alias("cat"))
        if kind == "creature":
            around = containment.contained(rest.select(F.col("t").alias("hay_id"), F.col("t").alias("hay")), names.select(F.col("t").alias("needle_id"), F.col("t").alias("needle"))).select(F.col("hay").alias("ref"), F.col("needle").alias("cat"))
            inside = inside.unionByName(around)
        part = inside.join(_first(catalog, F.lower(name)), F.col("cat") == F.col("k0")).groupBy("ref").agg(F.min("hit").alias("_hit"))
        out = left.join(part, F.lower("name") == F.col("ref"), "left")
        take = F.col("hit").isNull() & F.col("_hit").isNotNull()
        left = out.withColumn("tier", F.when(take, 4).otherwise(F.col("tier"))).withColumn("hit", F.coalesce("hit", "_hit")).select(left.columns)
    return left.withColumnRenamed("hit", "matched_ord")


def with_default_source(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tags (name, source) joined to catalog records; a missing source is the first one seen for that name."""
    key = lambda c: F.lower(F.trim(c))
    default = catalog.groupBy(key("name").alias("_n")).agg(F.min_by("source", "ord").alias("_default"))
    full = refs.join(default, key("name") == F.col("_n"), "left").withColumn("source", F.coalesce("source", "_default")).select(refs.columns)
    last = catalog.groupBy(key("name").alias("_n"), key("source").alias("_s")).agg(F.max_by(F.struct(*catalog.columns), "ord").alias("record"))
    return full.join(last, (key("name") == F.col("_n")) & (key("source") == F.col("_s")), "left").drop("_n", "_s")


# --- properties --------------------------------------------------------------------------------


def _get(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def creature_properties(body: Column) -> Column:
    """Variant record to a struct; the first element of a list, or the value itself."""
    first = lambda k, default: F.coalesce(_get(body, f"{k}[0]"), _get(body, k), F.lit(default))
    names = lambda k: F.transform(F.try_variant_get(body, f"$.{k}", "array<struct<name: string>>"), lambda x: x["name"])
    ability = lambda k: F.coalesce(_get(body, k, "int"), F.lit(10))
    abilities = F.struct(*(ability(k).alias(n) for k, n in (("str", "strength"), ("dex", "dexterity"), ("con", "constitution"), ("int", "intelligence"), ("wis", "wisdom"), ("cha", "charisma"))))
    return F.struct(
        first("size", "Unknown").alias("size"),
        F.coalesce(_get(body, "type.type"), _get(body, "type"), F.lit("Unknown")).alias("creature_type"),
        first("alignment", "Unknown").alias("alignment"),
        F.coalesce(_get(body, "ac[0].ac", "int"), _get(body, "ac[0]", "int"), _get(body, "ac", "int"), F.lit(0)).alias("armor_class"),
        _get(body, "hp.average", "int").alias("hit_points"),
        _get(body, "speed").alias("speed"),
        abilities.alias("abilities"),
        F.coalesce(F.try_variant_get(body, "$.senses", "array<string>"), F.array().cast("array<string>")).alias("senses"),
        F.coalesce(F.try_variant_get(body, "$.languages", "array<string>"), F.array().cast("array<string>")).alias("languages"),
        F.coalesce(_get(body, "cr.cr"), _get(body, "cr"), F.lit("Unknown")).alias("challenge_rating"),
        names("trait").alias("traits"),
        names("action").alias("actions"),
    )


def item_properties(body: Column) -> Column:
    damage = _get(body, "dmg1")
    return F.struct(
        F.coalesce(_get(body, "rarity"), F.lit("Unknown")).alias("rarity"),
        F.coalesce(_get(body, "type"), F.lit("Unknown")).alias("type"),
        F.coalesce(_get(body, "reqAttune", "boolean"), _get(body, "reqAttune").isNotNull()).alias("requires_attunement"),
        F.coalesce(_get(body, "wondrous", "boolean"), F.lit(False)).alias("wondrous"),
        _get(body, "weight", "double").alias("weight"),
        damage.alias("damage"),
        F.when(damage.isNotNull(), F.coalesce(_get(body, "dmgType"), F.lit(""))).alias("damage_type"),
        _get(body, "bonusSpellAttack").alias("spell_attack_bonus"),
        _get(body, "bonusSpellSaveDc").alias("spell_save_dc_bonus"),
    )


def spell_properties(body: Column) -> Column:
    number = lambda p, d: F.coalesce(_get(body, p), F.lit(d))
    time = F.when(_get(body, "time[0]").isNull(), "Unknown").otherwise(F.concat_ws(" ", number("time[0].number", "1"), number("time[0].unit", "action")))
    distance = F.when(_get(body, "range").isNull(), "Unknown").otherwise(F.concat_ws(" ", number("range.type", "Unknown"), number("range.distance.amount", "0"), number("range.distance.type", "feet")))
    kind = number("duration[0].type", "instant")
    duration = F.when(_get(body, "duration[0]").isNull(), "Instant").when(kind == "timed", F.concat_ws(" ", number("duration[0].duration.amount", "0"), number("duration[0].duration.type", "round"))).otherwise(kind)
    held = F.exists(F.try_variant_get(body, "$.duration", "array<struct<concentration: boolean>>"), lambda d: F.coalesce(d["concentration"], F.lit(False)))
    return F.struct(
        F.coalesce(_get(body, "level", "int"), F.lit(0)).alias("level"),
        number("school", "Unknown").alias("school"),
        time.alias("casting_time"),
        distance.alias("range"),
        duration.alias("duration"),
        _get(body, "components").alias("components"),
        F.coalesce(held, F.lit(False)).alias("requires_concentration"),
        F.try_variant_get(body, "$.damageInflict", "array<string>").alias("damage_types"),
        F.try_variant_get(body, "$.savingThrow", "array<string>").alias("saving_throw"),
    )


PROPERTIES = {"creature": creature_properties, "item": item_properties, "spell": spell_properties}
#: Records that stand in for those a catalog lacks, where their defaults differ from an empty record's.
DEFAULT_BODIES = {"creature": '{"ac": 10}', "item": "{}", "spell": '{"duration": [{"type": "Unknown"}]}'}
#: Node types of resolved kinds.
NODE_TYPES = {"creature": "Creature", "item": "Item", "spell": "Item", "action": "Item", "background": "Group"}


def resolve(refs: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """References (identifier, display_name, source_id) of one kind to entities, one a distinct identifier.

    id, label, type, source_file, mentions (sorted), properties, matched_ord; unmatched references
    get the properties of an empty record and the source in their identifier.
    """
    grouped = refs.groupBy("identifier", "display_name").agg(F.array_sort(F.collect_set("source_id")).alias("mentions"))
    parts = F.split("identifier", r"\|")
    grouped = grouped.withColumns({"ref_id": F.md5(F.concat_ws("\x01", "identifier", "display_name").cast("binary")), "name": F.get(parts, 0), "source": F.get(parts, 1)})
    found = match(grouped.select("ref_id", "name", "source"), catalog.select("ord", "name", "source"), kind)
    records = catalog.select(F.col("ord").alias("matched_ord"), F.col("body"), F.col("source").alias("source_file"))
    out = grouped.join(found.select("ref_id", "tier", "matched_ord"), "ref_id").join(records, "matched_ord", "left")
    body = F.parse_json(F.coalesce(F.col("body"), F.lit(DEFAULT_BODIES[kind])))
    known = F.col("matched_ord").isNotNull()
    return out.select(
        T.snake_id(F.when(known, F.col("name")).otherwise(F.col("display_name"))).alias("id"),
        F.col("display_name").alias("label"),
        F.lit(NODE_TYPES[kind]).alias("type"),
        F.when(known, F.col("source_file")).otherwise(F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("Unknown"))).alias("source_file"),
        "mentions",
        "tier",
        "matched_ord",
        PROPERTIES[kind](body).alias("properties"),
    )


def resolve_all(refs: DataFrame, catalogs: dict[str, DataFrame]) -> DataFrame:
    """References (entity_type, identifier, display_name, source_id) of every kind to one table of entities.

    Kinds with a catalog are resolved, with default properties where nothing matches; the others are
    kept as references. properties is JSON text.
    """
    out = None
    for kind in PROPERTIES:
        if kind in catalogs:
            own = resolve(refs.where(F.col("entity_type") == kind), catalogs[kind], kind)
            own = own.select("id", "label", "type", "source_file", "mentions", F.lit(kind).alias("entity_type"), "matched_ord", F.to_json("properties").alias("properties"))
            out = own if out is None else out.unionByName(own)
    rest = reference_only(refs.where(~F.col("entity_type").isin(*catalogs)))
    rest = rest.select("id", "label", "type", "source_file", "mentions", F.col("reference_type").alias("entity_type"), F.lit(None).cast("long").alias("matched_ord"), F.to_json(F.struct("reference_type")).alias("properties"))
    return rest if out is None else out.unionByName(rest)


def seeds(entities: DataFrame) -> DataFrame:
    """Resolved entities as nodes an extraction starts from: creature_type from a text, object or list, location_type `building` by default."""
    p = F.try_parse_json("properties")
    kind = F.coalesce(F.try_variant_get(p, "$.creature_type.type", "string"), F.try_variant_get(p, "$.creature_type[0]", "string"), F.try_variant_get(p, "$.creature_type", "string"))
    place = F.coalesce(F.try_variant_get(p, "$.location_type", "string"), F.lit("building"))
    return entities.select("id", "label", "type", F.when(F.col("type") == "Creature", kind).alias("creature_type"), F.when(F.col("type") == "Location", place).alias("location_type"), (T.is_generic_creature(F.col("label")) & (F.col("type") == "Creature")).alias("is_generic"))


def reference_only(refs: DataFrame) -> DataFrame:
    """Entities for links that no catalog holds (actions, backgrounds)."""
    kind = F.when(F.col("entity_type") == "background", "Group").otherwise("Item")
    out = refs.groupBy("entity_type", "display_name").agg(F.array_sort(F.collect_set("source_id")).alias("mentions"))
    return out.select(T.snake_id(F.col("display_name")).alias("id"), F.col("display_name").alias("label"), kind.alias("type"), F.lit("Adventure").alias("source_file"), "mentions", F.col("entity_type").alias("reference_type"))


def vertices(tag_refs: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """id (md5), label, name, source, attributes of tag references with their inherited records."""
    joined = with_default_source(tag_refs, inherited(catalog, kind))
    return joined.select(T.md5_id(kind, F.col("name"), F.col("source")).alias("id"), F.lit(kind.capitalize()).alias("label"), "name", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(F.col("record.body"), F.lit("{}")).alias("attributes"))


# --- inheritance -------------------------------------------------------------------------------


def _parent_keys(rows: DataFrame, index: DataFrame, default: DataFrame) -> DataFrame:
    """rows (with pn, ps) and parent, the index key (name, source) they copy: as named, else of the name's first source."""
    known = index.select("key")
    named = rows.join(default.withColumnsRenamed({"_n": "_dn", "_d": "pd"}), F.col("pn") == F.col("_dn"), "left").drop("_dn")
    named = named.withColumns({"_exact": F.struct(F.col("pn").alias("name"), F.col("ps").alias("source")), "_near": F.struct(F.col("pn").alias("name"), F.col("pd").alias("source"))})
    named = named.join(known.withColumnRenamed("key", "_e"), F.col("_exact") == F.col("_e"), "left").join(known.withColumnRenamed("key", "_f"), F.col("_near") == F.col("_f"), "left")
    return named.withColumn("parent", F.coalesce("_e", "_f")).drop("pn", "ps", "pd", "_exact", "_near", "_e", "_f")


def copy_links(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog's rows with their place (_i) and parent, and its index (key, body, parent): the last record of a name and source."""
    key = lambda c: F.lower(F.trim(c))
    copied = lambda body: F.try_parse_json(body)
    rows = materialise(catalog.withColumn("_i", F.monotonically_increasing_id()), "catalog")
    default = rows.groupBy(key("name").alias("_n")).agg(F.min_by(key("source"), "ord").alias("_d"))
    index = rows.groupBy(F.struct(key("name").alias("name"), key("source").alias("source")).alias("key")).agg(F.max_by("body", "ord").alias("body"))
    wanted = lambda t: t.withColumn("_v", copied("body")).withColumns({"pn": key(_get(F.col("_v"), "_copy.name")), "ps": key(_get(F.col("_v"), "_copy.source"))}).drop("_v")
    index = materialise(index, "index")
    return _parent_keys(wanted(rows), index, default), materialise(_parent_keys(wanted(index), index, default), "parents")


def copy_cycles(catalog: DataFrame) -> DataFrame:
    """name, source of the records whose `_copy` chain never ends, and the cycle's smallest name and source."""
    links = copy_links(catalog)[1].select(F.col("key").alias("id"), "parent")
    selves = links.where("id = parent").select("id", F.col("id").alias("root"))
    return chains.cycles(links).unionByName(selves).select("id.name", "id.source", F.col("root.name").alias("cycle_name"), F.col("root.source").alias("cycle_source"))


def inherited(catalog: DataFrame, kind: str, depth: int = MAX_DEPTH) -> DataFrame:
    """catalog (ord, name, source, body) with each body merged over its `_copy` parents and patched.

    Parents are found for all records by pointer doubling, up to depth of them; a record's chain is then
    merged in one place. A cycle is followed to that depth; copy_cycles() lists them.
    """
    rows, index = copy_links(catalog)
    above = chains.lineage(index.select(F.col("key").alias("id"), "parent"), depth - 1) if depth > 1 else None
    chain = F.array("parent")
    if above is not None:
        rows = rows.join(above, F.col("parent") == F.col("id"), "left").drop("id")
        own = F.col("parent")
        loop = F.transform(F.sequence(F.lit(1), F.lit(depth - 1)), lambda _: own)
        itself = index.where("key = parent").select(F.col("key").alias("_self"))
        rows = rows.join(itself, F.col("parent") == F.col("_self"), "left")
        chain = F.concat(chain, F.coalesce("ancestors", F.when(F.col("_self").isNotNull(), loop), F.slice(chain, 1, 0)))
    rows = materialise(rows.withColumn("_chain", F.when(F.col("parent").isNotNull(), chain)).select(*catalog.columns, "_i", "_chain"), "lineages")
    steps = rows.where("_chain IS NOT NULL").select("_i", F.posexplode("_chain").alias("_at", "key")).join(index.select("key", F.col("body").alias("_body")), "key")
    bodies = steps.groupBy("_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_body"))), lambda s: s["_body"]).alias("_bodies"))
    full = rows.join(bodies, "_i", "left").withColumn("chain", F.concat(F.array("body"), F.coalesce("_bodies", F.slice(F.array("body"), 1, 0))))
    gone = DROPPED_BY_KIND[kind]

    @F.pandas_udf("string")
    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda c: json.dumps(merge_chain([json.loads(x) for x in c], gone), ensure_ascii=False, sort_keys=True))

    return full.withColumn("body", merged("chain")).select(catalog.columns)


def merge_chain(chain: list[dict], dropped: tuple[str, ...]) -> dict:
    """A record and its parents, nearest first: from the farthest on, patch what is there, then lay the record over it."""
    out: dict[str, Any] = {}
    for depth, record in enumerate(reversed(chain)):
        patches = (record.get("_copy") or {}).get("_mod") if depth else None
        for target, mod in patches.items() if isinstance(patches, dict) else ():
            if target == "*":
                out = with_texts(out, _text_change(mod))
            elif isinstance(out.get(target), list):
                for m in mod if isinstance(mod, list) else [mod]:
                    out[target] = edited(out[target], m)
        out = {**out, **{k: v for k, v in record.items() if k not in ("_copy", "_mod", "_preserve")}}
        out = {k: v for k, v in out.items() if k not in dropped and not k.startswith("_")}
    return out


@functools.singledispatch
def with_texts(x: Any, change: Callable[[str], str]) -> Any:
    """x with every text inside changed; keys and other values stay."""
    return x


with_texts.register(str, lambda x, change: change(x))
with_texts.register(list, lambda x, change: [with_texts(v, change) for v in x])
with_texts.register(dict, lambda x, change: {k: with_texts(v, change) for k, v in x.items()})


def _text_change(mod: Any) -> Callable[[str], str]:
    """What a replaceTxt patch does to a text; anything else, and a pattern that isn't one, does nothing."""
    wanted = {"mode": "", "replace": None, "with": None, "flags": ""} | (mod if isinstance(mod, dict) else {})
    if wanted["mode"] == "replaceTxt" and isinstance(wanted["replace"], str) and isinstance(wanted["with"], str):
        with contextlib.suppress(re.error):
            pattern = re.compile(wanted["replace"], re.IGNORECASE * ("i" in (wanted["flags"] or "")))
            pattern.sub(wanted["with"], "")
            return functools.partial(pattern.sub, wanted["with"])
    return str


class ListEdit(NamedTuple):
    """What a patch mode does to a list: which key names items, how many of those go, and where its items come in."""

    named_by: str | None
    most: int | None
    put: str


EDITS = {"removeArr": ListEdit("names", None, "nowhere"), "replaceArr": ListEdit("replace", 1, "there"), "appendArr": ListEdit(None, 0, "end")}


def edited(items: list, mod: Any) -> list:
    """The list after one patch; an unknown mode leaves it as it is."""
    edit = EDITS.get(mod.get("mode")) if isinstance(mod, dict) else None
    if edit is None:
        return items
    named = mod.get(edit.named_by)
    names = [named] if edit.most == 1 or isinstance(named, str) else named or []
    hits = [i for i, v in enumerate(items) if (v.get("name") if isinstance(v, dict) else v) in names][: edit.most]
    new = mod.get("items")
    kept = [new if i in hits else v for i, v in enumerate(items) if edit.put == "there" or i not in hits]
    return kept + (new if isinstance(new, list) else [new]) if edit.put == "end" else kept
