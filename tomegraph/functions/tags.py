"""Inline tags `{@tag text|attr|…}`: cleaning, links, references (DOC-11..13, 16, 18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LINK

TAG = r"(?U)\{@(\w++)\s+([^{}]+)\}"
#: Tags that only format, and the groups of the others.
FORMATTING = ("b", "i", "u", "s", "c", "color", "note", "bold", "italic", "strikethrough", "underline", "comic", "book", "filter")
GROUPS = {
    "entity": ("creature", "item", "spell", "action", "background"),
    "navigation": ("area", "adventure", "book", "quickref", "5etoolsImg"),
    "mechanic": ("dc", "dice", "skill", "condition", "sense"),
}
#: More parts than a tag can have.
MOST = 1 << 30
#: A brace that is still open where a tag begins: only then can a tag lie in another, or a new one come out of stripping.
NESTED = r"\{[^{}]*\{@"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\{@\w++\s+(?=[^{}])([^{}|]*)(?:\|[^{}]*)?\}", "$1")


def _links(text: Column, raw: bool = False) -> Column:
    """Links of one pass, in order of place."""
    names, bodies = (F.regexp_extract_all(text, F.lit(TAG), F.lit(i)) for i in (1, 2))

    def link(tag: Column, body: Column) -> Column:
        attrs = F.slice(F.split(body, r"\|"), 2, MOST)
        return F.struct(F.substring_index(body, "|", 1).alias("text"), tag.alias("tag"), attrs.alias("attrs"))

    got = F.zip_with(names, bodies, link)
    if raw:
        whole = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
        got = F.zip_with(got, whole, lambda x, w: F.struct(x["text"].alias("text"), x["tag"].alias("tag"), x["attrs"].alias("attrs"), w.alias("raw")))
    return got


def _depth(text: Column) -> Column:
    """How deep braces nest: no text needs more passes."""
    step = lambda s, x: F.struct((F.when(x == "{", s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0)))).alias("open"), F.greatest(s["most"], s["open"] + F.when(x == "{", 1).otherwise(0)).alias("most"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)), F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")), step, lambda s: s["most"])


def clean_text(text: Column) -> Column:
    """The text with its tags resolved from the inside out, until none is left."""
    step = lambda s, _: F.when(s.rlike(TAG), _strip(s)).otherwise(s)
    deep = F.aggregate(F.sequence(F.lit(1), _depth(text)), text, step)
    return F.when(~F.contains(text, F.lit("{@")), text).when(text.rlike(NESTED), deep).otherwise(_strip(text))


def all_links(text: Column) -> Column:
    """Links of all passes in order, formatting tags left out, each once."""
    none = F.array().cast(f"array<{LINK}>")
    once = lambda s: F.struct(_strip(s["text"]).alias("text"), F.concat(s["links"], _links(s["text"])).alias("links"))
    step = lambda s, _: F.when(s["text"].rlike(TAG), once(s)).otherwise(s)
    deep = F.aggregate(F.sequence(F.lit(1), _depth(text)), F.struct(text.alias("text"), none.alias("links")), step, lambda s: s["links"])
    found = F.when(~F.contains(text, F.lit("{@")), none).when(text.rlike(NESTED), deep).otherwise(_links(text))
    return F.array_distinct(F.filter(found, lambda x: ~x["tag"].isin(*FORMATTING)))


def _named(whole: Column) -> Column:
    """Links of tags that were found, in their order."""

    def link(w: Column) -> Column:
        tag, body = (F.regexp_extract(w, TAG, i) for i in (1, 2))
        return F.struct(F.substring_index(body, "|", 1).alias("text"), tag.alias("tag"), F.slice(F.split(body, r"\|"), 2, MOST).alias("attrs"))

    return F.transform(whole, link)


def parse_and_clean(text: Column) -> Column:
    """struct<text, links> of clean_text() and all_links(), both from the same passes.

    A pass looks for tags once: they are its links, and where there are none the text is done. Every pass takes a closing brace at least.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{LINK}>")
    kept = lambda links: F.array_distinct(F.filter(links, lambda x: ~x["tag"].isin(*FORMATTING)))
    state = lambda t, links, *more: F.struct(t.alias("text"), links.alias("links"), *more)
    open_ = lambda x: x.alias("open")
    found = lambda t: F.regexp_extract_all(t, F.lit(TAG), F.lit(0))
    once = lambda s, got: F.when(F.size(got) > 0, state(_strip(s["text"]), F.concat(s["links"], _named(got)), open_(F.lit(True)))).otherwise(state(s["text"], s["links"], open_(F.lit(False))))
    step = lambda s, _: F.when(s["open"], F.get(F.transform(F.array(found(s["text"])), lambda got: once(s, got)), 0)).otherwise(s)
    most = F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit("")))
    deep = F.aggregate(F.sequence(F.lit(0), most), state(text, none, open_(F.lit(True))), step, lambda s: state(s["text"], kept(s["links"])))
    return F.when(~F.contains(text, F.lit("{@")), state(text, none)).when(text.rlike(NESTED), deep).otherwise(state(_strip(text), kept(_named(found(text)))))


def parse_once(text: Column) -> Column:
    """struct<text, links>: one pass, outer tags of nested ones stay; links keep formatting tags and their raw form."""
    return F.struct(_strip(F.coalesce(text, F.lit(""))).alias("text"), _links(F.coalesce(text, F.lit("")), raw=True).alias("links"))


def grouped(links: Column, group: str) -> Column:
    return F.filter(links, lambda x: x["tag"].isin(*GROUPS[group]))


def external_ref(link: Column) -> Column:
    """struct<entity_type, identifier, display_name>; creature, item and spell carry their source."""
    source = F.get(link["attrs"], 0)
    named = link["tag"].isin("creature", "item", "spell") & source.isNotNull()
    return F.struct(link["tag"].alias("entity_type"), F.when(named, F.concat_ws("|", link["text"], source)).otherwise(link["text"]).alias("identifier"), link["text"].alias("display_name"))


def tag_references(text: Column) -> Column:
    """array<struct<kind, name, source>> of creature, item and spell tags anywhere in a raw text; no source is null."""
    pattern = r"\{@(creature|item|spell) ([^\}]+)\}"
    kinds, bodies = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))

    def ref(kind: Column, body: Column) -> Column:
        parts = F.split(body, r"\|")
        source = F.trim(F.get(parts, 1))
        return F.struct(kind.alias("kind"), F.trim(F.get(parts, 0)).alias("name"), F.when(source != "", source).alias("source"))

    return F.zip_with(kinds, bodies, ref)
