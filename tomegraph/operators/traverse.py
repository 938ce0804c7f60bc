"""Section tables by document order, parent, depth and mention (FLT-1..9, AGG-16, AGG-17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import NO_SPATIAL_INFO
from ..session import materialise, spread
from . import graph


def preorder(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("doc_id", "path")


def postorder(nodes: DataFrame) -> DataFrame:
    """Children before their parent: a path sorts behind everything that starts with it."""
    return nodes.orderBy("doc_id", F.concat("path", F.array(F.lit(2**31 - 1))))


def with_family(nodes: DataFrame) -> DataFrame:
    """Sections with content, with their parent's title and their children's titles in order."""
    titles = nodes.select("doc_id", F.col("path").alias("parent_path"), F.col("title").alias("parent_title"))
    kids = nodes.where(F.size("parent_path") > 0).groupBy("doc_id", F.col("parent_path").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "title"))), lambda s: s["title"]).alias("child_titles"))
    out = nodes.where(~T.is_blank(F.col("content"))).join(titles, ["doc_id", "parent_path"], "left").join(kids, ["doc_id", "path"], "left")
    return out.withColumn("child_titles", F.coalesce("child_titles", F.array().cast("array<string>")))


def longer_than(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.where(F.length("content") >= n)


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return preorder(nodes.where(F.col("type") == kind))


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The first section of that id in each document."""
    hit = nodes.where(F.col("node_id") == node_id)
    return hit.groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in nodes.columns if c != "doc_id")), "path").alias("r")).select("doc_id", "r.*")


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def mentions(nodes: DataFrame, entity: str) -> DataFrame:
    """Sections with a link whose text equals the entity, case aside."""
    return preorder(nodes.where(F.exists("links", lambda x: F.lower(x["text"]) == entity.lower())))


def subtree(nodes: DataFrame, doc_id: str, path: list[int], max_depth: int = 3) -> DataFrame:
    """Sections at or below path, at most max_depth levels down."""
    n = len(path)
    root = F.array(*(F.lit(i) for i in path)) if path else F.array().cast("array<int>")
    return preorder(nodes.where((F.col("doc_id") == doc_id) & (F.slice("path", 1, n) == root) & (F.size("path") - n <= max_depth))) if n else preorder(nodes.where((F.col("doc_id") == doc_id) & (F.col("depth") <= max_depth)))


def roots(nodes: DataFrame) -> DataFrame:
    return preorder(nodes.where("depth = 0"))


def cards(nodes: DataFrame, paragraphs: int = 10, chars: int = 200) -> DataFrame:
    """Section data, link counts by group, and the first paragraphs shortened."""
    from ..functions import tags

    counts = [F.size(tags.grouped(F.col("links"), g)).alias(f"n_{g}") for g in tags.GROUPS]
    text = F.transform(F.slice(F.split("content", "\n"), 1, paragraphs), lambda p: F.substring(p, 1, chars))
    return nodes.select("doc_id", "node_id", "title", "type", *counts, text.alias("paragraphs"))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Titles of a section's ancestors and its own, joined by ` > `."""
    up = nodes.select("doc_id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("i", "up"))
    t = up.join(nodes.select("doc_id", F.col("path").alias("up"), "title"), ["doc_id", "up"])
    return t.groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda s: s["title"]), " > ").alias("breadcrumb"))


def own_and_below(level: DataFrame) -> DataFrame:
    """level (content, below) with both as the answer."""
    return level.withColumn("answer", F.concat_ws("\n", F.when(~T.is_blank(F.col("content")), F.col("content")), "below"))


def texts_below(nodes: DataFrame, sentinel: str = NO_SPATIAL_INFO) -> DataFrame:
    """What roll_up() gives without a model, in two shuffles instead of two a level.

    A section's summary is `[title]: content` of itself and of all sections below that tell something, in
    preorder, with a line break behind each content but the last. So every such section is handed to all its
    ancestors at once (its path's beginnings), as many rows as the summaries have parts. The
    sections' parents must be in the table.
    """
    key, told = ["doc_id", "path"], ~T.is_blank(F.col("content"))
    nodes = materialise(nodes.select(*key, "title", "content"), "sections")
    upward = lambda t: t.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))))
    telling = nodes.where(told & (F.trim("content") != sentinel)).select(*key)
    valid = upward(telling).select("doc_id", F.col("at").alias("path")).distinct()
    parts = nodes.join(valid, key).select(*key, F.concat(F.lit("["), F.col("title"), F.lit("]: "), F.when(told, F.col("content")).otherwise("")).alias("part"), told.alias("ends"))
    gathered = upward(parts).groupBy("doc_id", F.col("at").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("place"), "part", "ends"))).alias("parts"))
    pieces = F.transform("parts", lambda p, i: F.concat(p["part"], F.when(p["ends"] & (i + 1 < F.size("parts")), "\n").otherwise("")))
    text = gathered.select(*key, F.array_join(pieces, "").alias("summary"))
    # containers that are no sections have beginnings of paths too: only sections are kept
    return nodes.join(text, key, "left").select(*key, F.when(F.col("summary").isNull() & told, F.lit(sentinel)).otherwise(F.col("summary")).alias("summary"))


def roll_up(nodes: DataFrame, summarise: Callable[[DataFrame], DataFrame] | None = None, sentinel: str = NO_SPATIAL_INFO) -> DataFrame:
    """doc_id, path, summary from the leaves up.

    Without summarise the summaries are texts made of texts, so all of them come from one pass over the
    sections (see texts_below), however deep the tree; a model needs the answers below first and is asked level by level.
    Each level gets `below`, its children's summaries in order joined by a newline (blank ones and the
    sentinel left out), and becomes `[title]: …` by summarise (which adds `answer`; by default content
    and below). A section without content and valid children keeps a null summary, unlike one that
    answered the sentinel.
    """
    if summarise is None and nodes.where(F.size("parent_path") > 0).join(nodes.select("doc_id", F.col("path").alias("parent_path")), ["doc_id", "parent_path"], "left_anti").isEmpty():
        return texts_below(nodes, sentinel)
    answer = summarise or own_and_below
    levels = nodes.agg(F.max("depth")).first()[0]
    done = None
    for depth in range(levels if levels is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("below", F.lit(None).cast("string"))
        else:
            valid = done.where(~T.is_blank(F.col("summary")) & (F.col("summary") != sentinel))
            kids = valid.groupBy("doc_id", F.col("parent_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "summary"))), lambda s: s["summary"]), "\n").alias("below"))
            level = level.join(kids, ["doc_id", "path"], "left")
        asked = answer(level.where(~T.is_blank(F.col("content")) | F.col("below").isNotNull()))
        text = F.when(T.is_blank(F.col("answer")) | (F.trim("answer") == sentinel), F.lit(sentinel)).otherwise(F.concat(F.lit("["), F.col("title"), F.lit("]: "), F.col("answer")))
        some = asked.select("doc_id", "path", "parent_path", text.alias("summary"))
        none = level.where(T.is_blank(F.col("content")) & F.col("below").isNull()).select("doc_id", "path", "parent_path", F.lit(None).cast("string").alias("summary"))
        now = materialise(some.unionByName(none), "summaries")
        done = now if done is None else done.unionByName(now)
    empty = nodes.select("doc_id", "path", F.lit(None).cast("string").alias("summary")).limit(0)
    return empty if done is None else done.select("doc_id", "path", "summary")


def trees(nodes: DataFrame, fields: tuple[str, ...] = ("node_id", "title", "type", "content")) -> DataFrame:
    """doc_id, body: the flat table as one JSON array of roots a document, children inside their parents in order.

    Built level by level from the leaves; a section whose parent is absent counts as a root.
    """
    known = nodes.select("doc_id", F.col("path").alias("parent_path"), F.lit(True).alias("_up"))
    placed = nodes.join(known, ["doc_id", "parent_path"], "left").select("doc_id", "path", "parent_path", "depth", F.coalesce("_up", F.lit(False)).alias("inside"), *fields)
    levels = placed.agg(F.max("depth")).first()[0]
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "body"))), lambda x: x["body"]), ",")
    below, top = None, None
    for depth in range(levels if levels is not None else -1, -1, -1):
        level = placed.where(F.col("depth") == depth)
        level = level.withColumn("kids", F.lit("")) if below is None else level.join(below, ["doc_id", "path"], "left")
        own = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        body = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}"))
        level = materialise(level.select("doc_id", "path", "parent_path", "inside", body.alias("body")), "tree-level")
        below = level.where("inside").groupBy("doc_id", F.col("parent_path").alias("path")).agg(joined().alias("kids"))
        roots_ = level.where("NOT inside").select("doc_id", "path", "body")
        top = roots_ if top is None else top.unionByName(roots_)
    if top is None:
        return nodes.select("doc_id", F.lit("").alias("body")).limit(0)
    return top.groupBy("doc_id").agg(F.concat(F.lit("["), joined(), F.lit("]")).alias("body"))


def accumulated(entities: DataFrame) -> DataFrame:
    """Entities (doc_id, path, id, label, ord) of each section and all below it, each id once, own ones first.

    A task sorts its rows, one for each entity and ancestor, before it combines them: so each gets an even share.
    """
    up = spread(entities).withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))))
    place = up.withColumn("_o", F.struct("path", "ord"))
    return graph.first_wins(place, ["doc_id", "at", "id"], ord="_o").drop("_o")
