"""Nested documents to tables of sections (DOC-1..10, 14, 15, 17, SRC-13).

A frontier of variant values goes down the documents level by level: each round explodes the `entries`
of all containers found in the round before, over all documents at once, and writes what it found. So one
huge book is spread over the tasks, no Python worker parses JSON, and there are as many rounds as the deepest
nesting. Tags are resolved by column expressions afterwards.

Two profiles: `shadow` opens a section at every structural entry and follows those alone; `indexed`
asks for an id as well, takes other containers as part of the section around them, and leaves table
cells and list marks outside tag parsing.

Defined cases: a body that is null or no JSON (or repeats a key within an object) has no sections; one too large
for a variant is an error; `entries`, `items` and the like that are no lists count as absent; an object or list
as a table cell is written as JSON, its keys in alphabetical order; numbers are written without trailing zeros, and
a page is a whole number or null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..model import STRUCTURAL_TYPES
from ..session import Levels, materialise, spread

_LINE = "struct<prefix: string, text: string, tagged: boolean>"
PROFILES = ("shadow", "indexed")
#: Bytes from which a body that can't be read may be too large instead of broken.
LARGE_BYTES = 16 << 20


# --- variants ------------------------------------------------------------------------------------


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID and so on."""
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def _is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("ARRAY")), F.lit(False))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _given(v: Column) -> Column:
    """Neither absent, null, empty, zero nor false."""
    return F.coalesce(v.isNotNull() & (_kind(v) != "VOID") & ~F.to_json(v).isin('""', "0", "0.0", "false", "[]", "{}"), F.lit(False))


def _plain(v: Column) -> Column:
    """Any value as text: words for truth values and null, JSON with blanks for objects and lists."""
    spaced = F.regexp_replace(F.to_json(v), r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([:,])', "$1$2 ")
    return F.when(_is_text(v), _string(v)).when(_kind(v) == "BOOLEAN", F.initcap(_string(v))).when(_kind(v) == "VOID", "None").when(_is_object(v) | _is_list(v), spaced).otherwise(_string(v))


# --- content -------------------------------------------------------------------------------------


def _line(text: Column, prefix: Column | None = None, tagged: bool = True) -> Column:
    return F.struct((F.lit("") if prefix is None else prefix).alias("prefix"), text.alias("text"), F.lit(tagged).alias("tagged"))


def _none() -> Column:
    return F.array().cast(f"array<{_LINE}>")


def _one(condition: Column, line: Column) -> Column:
    return F.when(condition, F.array(line)).otherwise(_none())


def _image(v: Column) -> Column:
    """The line of an image, null without a title."""
    kind = F.when(_given(_get(v, "imageType")), F.concat(F.lit(" ("), _plain(_get(v, "imageType")), F.lit(")"))).otherwise("")
    return F.when(_given(_get(v, "title")), F.concat(F.lit("[Image"), kind, F.lit(": "), _plain(_get(v, "title")), F.lit("]")))


def _list_lines(e: Column, indexed: bool) -> Column:
    def line(item: Column) -> Column:
        mark = F.when(_is_object(item) & _given(_get(item, "name")), F.concat(F.lit("- **"), _plain(_get(item, "name")), F.lit("**: "))).otherwise("- ")
        text = F.when(_is_object(item), F.when(_is_text(_get(item, "entry")), _string(_get(item, "entry")))).when(_is_text(item), _string(item))
        return _line(text, mark) if indexed else _line(F.concat(mark, text))

    kept = F.filter(F.transform(_items(_get(e, "items")), line), lambda x: x["text"].isNotNull())
    return F.filter(kept, lambda x: x["text"] != "") if indexed else kept


def _table_lines(e: Column, indexed: bool) -> Column:
    caption = _one(_given(_get(e, "caption")), _line(F.concat(F.lit("**Table: "), _plain(_get(e, "caption")), F.lit("**")), tagged=not indexed))
    row = lambda r: F.when(_is_list(r), F.array_join(F.transform(_items(r), _plain), " | ")).otherwise(_plain(r))
    rows = F.transform(_items(_get(e, "rows")), lambda r: _line(row(r), tagged=not indexed))
    return F.concat(caption, F.filter(rows, lambda x: x["text"] != ""))


def _gallery_lines(e: Column, indexed: bool) -> Column:
    shown = F.filter(F.transform(_items(_get(e, "images")), lambda v: _line(_image(v))), lambda x: x["text"].isNotNull())
    return F.concat(_one(F.lit(True) if indexed else F.size(shown) > 0, _line(F.lit("**Gallery:**"))), shown)


def _quote_lines(e: Column) -> Column:
    said = F.transform(_items(_get(e, "entries")), lambda v: _line(F.when(_is_text(v), F.concat(F.lit("> "), _string(v)))))
    return F.filter(said, lambda x: x["text"].isNotNull())


def _lines(e: Column, kind: Column, indexed: bool) -> Column:
    """Lines of an entry that is content; null if its form is unknown."""
    return (
        F.when(_is_text(e), _one(_string(e) != "", _line(_string(e))))
        .when(kind == "list", _list_lines(e, indexed))
        .when(kind == "table", _table_lines(e, indexed))
        .when(kind == "image", _one(_image(e).isNotNull(), _line(_image(e))))
        .when(kind == "gallery", _gallery_lines(e, indexed))
        .when(kind == "quote", _quote_lines(e))
    )


# --- the frontier --------------------------------------------------------------------------------


def _found(frontier: DataFrame, indexed: bool) -> DataFrame:
    """What the entries (e) of a level are: sections, containers that are followed, or content of the owner."""
    e, kind = F.col("e"), F.col("kind")
    structural = F.coalesce(kind.isin(*STRUCTURAL_TYPES), F.lit(False)) & (_given(_get(e, "id")) if indexed else F.lit(True))
    top = F.size("path") == 1
    # a quote is a container only where no section is around it yet
    through = F.when(top, _is_object(e)).otherwise(_is_list(_get(e, "entries")) & ~F.coalesce(kind == "quote", F.lit(False))) if indexed else F.lit(False)
    role = F.when(structural, "section").when(through, "through").when(F.col("owner").isNotNull(), "content")
    page = _get(e, "page")
    is_section = F.col("role") == "section"
    out = frontier.withColumn("kind", F.when(_is_text(_get(e, "type")), _string(_get(e, "type")))).withColumn("role", role).where("role IS NOT NULL")
    of_section = lambda value: F.when(is_section, value)
    return out.select(
        "doc", "doc_id", "path", "owner", "role", F.when(is_section, F.coalesce(F.col("depth") + 1, F.lit(0))).otherwise(F.col("depth")).alias("depth"),
        of_section(F.when(_given(_get(e, "id")), _plain(_get(e, "id"))).otherwise("")).alias("node_id"),
        of_section(F.when(_given(_get(e, "name")), _plain(_get(e, "name"))).otherwise("Untitled Section")).alias("title"),
        of_section(kind).alias("type"), of_section(F.when(~_kind(page).isin("STRING", "BOOLEAN") & F.rlike(_string(page), F.lit("^-?[0-9]+$")), F.try_variant_get(page, "$", "int"))).alias("page"),
        F.when(F.col("role") == "content", _lines(e, kind, indexed)).alias("lines"), F.when(F.col("role") != "content", _get(e, "entries")).alias("entries"),
    )


def raw_nodes(docs: DataFrame, profile: str = "shadow", line: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Sections (doc_id, path, parent_path, depth, node_id, title, type, page, lines, ignored) with their lines as found.

    line is applied to every line where it was found, before the lines of a section are brought together.
    """
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    indexed = profile == "indexed"
    body = F.col("body")
    # the levels below are read from the files of this one, so documents dealt evenly keep all rounds even
    read = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("body").cast("string").alias("body"))).withColumn("doc", F.monotonically_increasing_id())
    read = read.withColumn("v", F.when((F.octet_length(body) >= LARGE_BYTES) & F.try_parse_json(body).isNull(), F.raise_error("a document is too large or no JSON").cast("variant")).otherwise(F.try_parse_json(body)))
    start = read.select("doc", "doc_id", F.when(_is_list(F.col("v")), F.col("v")).otherwise(_get(F.col("v"), "data")).alias("entries"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("owner"), F.lit(None).cast("int").alias("depth"))

    def below(t: DataFrame) -> DataFrame:
        each = t.select("doc", "doc_id", "owner", "depth", "path", F.posexplode(_items(F.col("entries"))).alias("i", "e"))
        return _found(each.select("doc", "doc_id", "owner", "depth", F.concat("path", F.array("i")).alias("path"), "e"), indexed)

    # documents are parsed once, here, so that the numbers of rows hold
    levels = Levels(docs.sparkSession, below(materialise(start, "documents")))
    while True:
        inner = levels.last.where("role <> 'content'").withColumn("owner", F.when(F.col("role") == "section", F.col("path")).otherwise(F.col("owner")))
        if not levels.add(below(inner)):
            break
    every = levels.all
    sections = every.where("role = 'section'").select("doc", "doc_id", "path", F.coalesce("owner", F.array().cast("array<int>")).alias("parent_path"), "depth", "node_id", "title", "type", "page")
    content = every.where("role = 'content'").withColumn("lines", F.transform("lines", line)).groupBy("doc", F.col("owner").alias("path")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("lines") > 0, F.struct("path", "lines")))), lambda x: x["lines"])).alias("lines"), F.count(F.when(F.col("lines").isNull(), 1)).cast("int").alias("ignored")
    )
    out = sections.join(content, ["doc", "path"], "left")
    none = F.array().cast(content.schema["lines"].dataType)
    return out.select("doc_id", "path", "parent_path", "depth", "node_id", "title", "type", "page", F.coalesce("lines", none).alias("lines"), F.coalesce("ignored", F.lit(0)).alias("ignored"))


def flatten(docs: DataFrame, profile: str = "shadow") -> DataFrame:
    """doc_nodes of documents (doc_id, body): content with tags resolved, links de-duplicated (kept as found in `indexed`)."""
    if profile == "indexed":
        clean = lambda x: tags.parse_once(x["text"])
    else:
        clean = lambda x: tags.parse_and_clean(x["text"])
    raw = raw_nodes(docs, profile, lambda x: F.struct(x["prefix"].alias("prefix"), x["text"].alias("text"), x["tagged"].alias("tagged"), clean(x).alias("parsed"))).withColumnRenamed("lines", "done")
    text = F.array_join(F.transform("done", lambda x: F.concat(x["prefix"], F.when(x["tagged"], x["parsed"]["text"]).otherwise(x["text"]))), "\n")
    links = F.flatten(F.transform(F.filter("done", lambda x: x["tagged"]), lambda x: x["parsed"]["links"]))
    links = links if profile == "indexed" else F.array_distinct(links)
    return raw.select("doc_id", "path", "parent_path", "depth", "node_id", "title", "type", "page", text.alias("content"), links.alias("links"), "ignored")


def external_refs(nodes: DataFrame) -> DataFrame:
    """entity_type, identifier, source_id, display_name of entity links, in order (DOC-16)."""
    each = nodes.select("doc_id", "node_id", "path", F.posexplode(tags.grouped(F.col("links"), "entity")).alias("link_ord", "link"))
    return each.select("doc_id", F.col("node_id").alias("source_id"), "path", "link_ord", tags.external_ref(F.col("link")).alias("r")).select("doc_id", "source_id", "path", "link_ord", "r.*")


def entry_types(docs: DataFrame) -> DataFrame:
    """All distinct string `type` values anywhere in the documents, sorted.

    In compact JSON a key stands right behind a brace or comma, and no text within quotes can look like that.
    """
    text = F.to_json(F.try_parse_json(F.col("body").cast("string")))
    found = F.regexp_extract_all(text, F.lit(r'[{,]"type":"((?:[^"\\]|\\.)*)"'), 1)
    plain = F.get_json_object(F.concat(F.lit('{"v":"'), F.col("t"), F.lit('"}')), "$.v")
    return docs.select(F.explode(F.array_distinct(found)).alias("t")).distinct().select(plain.alias("type")).orderBy("type")
