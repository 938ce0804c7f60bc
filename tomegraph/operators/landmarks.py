"""Distance labels for path queries (GRA-10, GRA-11): pruned landmark labelling as a table.

Nodes are ranked by degree. A label (side, id, hub, d, next) says that the hub is d steps from id and which
neighbour comes next on the way; side 'in' reads hub to id, 'out' id to hub, 'any' both in an undirected graph.
A hub labels only nodes ranked below it, and none that a higher hub already gives as short a way to, so of
all shortest paths between two nodes the highest node is a hub of both. A distance is then a join of two
sets of labels, which are computed once and serve every query.

All hubs grow together, one level a round: the labels that can prune a level are those of the levels before.

Defined cases: links of a node to itself and links with a null end don't count; a node is 0 from itself, whether it has
links or not; pairs with a null or further apart than max_edges give no row; repeated pairs give one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Levels, materialise
from . import ranks

COLUMNS = ["side", "id", "hub", "d", "next"]


def _steps(edges: DataFrame, undirected: bool) -> DataFrame:
    """side, a, b: from a, nearer to a hub, to b."""
    e = edges.select("source", "target").where("source <> target")
    sides = ("any", "any") if undirected else ("in", "out")
    ahead = e.select(F.lit(sides[0]).alias("side"), F.col("source").alias("a"), F.col("target").alias("b"))
    return ahead.unionByName(e.select(F.lit(sides[1]).alias("side"), F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def labels(edges: DataFrame, max_edges: int | None = None, undirected: bool = False) -> DataFrame:
    """side, id, hub, d, next of a graph (source, target), for paths of at most max_edges."""
    steps = materialise(_steps(edges, undirected), "steps")
    degree = steps.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    rank = materialise(ranks.numbered(degree.orderBy(F.desc("n"), "id").select("id")), "ranks")
    steps = steps.join(rank.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    steps = materialise(steps.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a"), "ranked")
    first = steps.where("ra < rb").select("side", F.col("b").alias("id"), F.col("a").alias("hub"), F.lit(1).alias("d"), F.col("a").alias("next"), F.col("ra").alias("rank"))
    levels, k = Levels(edges.sparkSession, first), 1
    ahead = steps.select(F.col("side").alias("_side"), "a", "b", "rb")
    while (max_edges is None or k < max_edges) and not levels.last.isEmpty():
        k += 1
        grown = levels.last.join(ahead, (F.col("side") == F.col("_side")) & (F.col("id") == F.col("a")) & (F.col("rank") < F.col("rb")))
        fresh = grown.groupBy("side", F.col("b").alias("id"), "hub").agg(F.min("id").alias("next"), F.min("rank").alias("rank"))
        fresh = materialise(fresh.join(levels.all.select("side", "id", "hub"), ["side", "id", "hub"], "left_anti"), "fresh")
        levels.add(fresh.join(_covered(fresh, levels.all, k, undirected), ["side", "id", "hub"], "left_anti").withColumn("d", F.lit(k)))
    return levels.all.select(COLUMNS)


def _covered(fresh: DataFrame, known: DataFrame, k: int, undirected: bool) -> DataFrame:
    """side, id, hub of fresh labels for which a hub above theirs gives a way of at most k."""
    other = F.col("side") if undirected else F.when(F.col("side") == "in", "out").otherwise("in")
    near = known.select(other.alias("side"), F.col("id").alias("hub"), F.col("hub").alias("via"), F.col("d").alias("d1"))
    far = known.select("side", "id", F.col("hub").alias("via"), F.col("d").alias("d2"))
    ways = fresh.select("side", "id", "hub").join(near, ["side", "hub"]).join(far, ["side", "id", "via"])
    return ways.where(F.col("d1") + F.col("d2") <= k).select("side", "id", "hub").distinct()


#: Rows of sets' best hubs and of broken ways that go to every task; beyond, they are joined by a shuffle.
SMALL = 100_000


def small(t: DataFrame) -> DataFrame:
    return F.broadcast(t) if t.count() <= SMALL else t


def _sets(table: DataFrame, asked: DataFrame, sides: tuple) -> tuple[DataFrame, DataFrame]:
    """id, set of the nodes asked (id) and set, hub, d of their labels: nodes with the same labels share a set, named by one of them.

    A hub's label to itself counts here; that of other nodes tells nothing but that a node is 0 from itself.
    """
    own = table.where(F.col("side").isin(*sides)).join(asked, "id", "left_semi").select("id", "hub", "d")
    hubs = table.select(F.col("hub").alias("id")).distinct().join(asked, "id", "left_semi")
    held = own.unionByName(hubs.select("id", F.col("id").alias("hub"), F.lit(0).alias("d"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hub", "d"))).alias("ways"))
    held = materialise(held, "held")
    sets = materialise(held.groupBy("ways").agg(F.min("id").alias("set")), "sets")
    return materialise(held.join(sets, "ways").select("id", "set"), "names"), sets.select("set", F.explode("ways").alias("w")).select("set", "w.*")


def _best(table: DataFrame, pairs: DataFrame, max_edges: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """start, end, d, hub: the hub on a shortest way of each pair, the smallest of several; then the names of starts and of ends (id, set) and the sets' hubs.

    The hub depends on the two sets of labels alone, so it is sought once for each two sets that meet, and pairs carry two names.
    """
    pairs = pairs.select("start", "end").where("start IS NOT NULL AND end IS NOT NULL").distinct()
    pairs = materialise(pairs, "pairs")
    named, ways = [], []
    for end, sides in (("start", ("out", "any")), ("end", ("in", "any"))):
        names, labels_ = _sets(table, pairs.select(F.col(end).alias("id")).distinct(), sides)
        named.append(names)
        ways.append(labels_)
    at = pairs
    for end, names in zip(("start", "end"), named, strict=True):
        at = at.join(names.select(F.col("id").alias(end), F.col("set").alias(f"_{end}")), end, "left")
    at = materialise(at, "named")
    met = at.select("_start", "_end").where("_start IS NOT NULL AND _end IS NOT NULL").distinct()
    both = met.join(ways[0].select(F.col("set").alias("_start"), "hub", F.col("d").alias("d1")), "_start").join(ways[1].select(F.col("set").alias("_end"), "hub", F.col("d").alias("d2")), ["_end", "hub"])
    best = both.groupBy("_start", "_end").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("d"), "hub", "d1", "d2")).alias("b")).select("_start", "_end", "b.*")
    best = materialise(best.where(F.col("d") <= max_edges) if max_edges is not None else best, "best")
    same = F.col("start") == F.col("end")
    out = at.join(small(best.select("_start", "_end", "d", "hub")), ["_start", "_end"], "left")
    out = out.select("start", "end", F.when(same, 0).otherwise(F.col("d")).alias("d"), F.when(same, F.col("start")).otherwise(F.col("hub")).alias("hub")).where("d IS NOT NULL")
    return out, *named, best


def distances(table: DataFrame, pairs: DataFrame, max_edges: int | None = None) -> DataFrame:
    """start, end, d of the pairs (start, end) that a way connects."""
    return _best(table, pairs, max_edges)[0].select("start", "end", "d")


def _ways(table: DataFrame, names: DataFrame, hubs: DataFrame, side: str) -> DataFrame:
    """id, hub, path of the nodes in names (id, set) and their sets' hubs (set, hub, d), over the next nodes."""
    at = materialise(names.join(small(hubs.distinct()), "set").select("id", "hub", "d", F.array("id").alias("path")), "ways")
    onward = table.where(F.col("side").isin(side, "any")).select(F.col("id").alias("_at"), F.col("hub").alias("_hub"), "next")
    for _ in range(at.agg(F.max("d")).first()[0] or 0):
        grown = at.join(onward, (F.element_at("path", -1) == F.col("_at")) & (F.col("hub") == F.col("_hub")), "left")
        at = materialise(grown.withColumn("path", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))).select(at.columns), "ways")
    return at.select("id", "hub", "path")


def routes(table: DataFrame, pairs: DataFrame, max_edges: int | None = None) -> DataFrame:
    """start, end, d, path: a shortest path of each pair; the ways between a node and a hub are built once for all pairs they serve."""
    at, starts, ends, best = _best(table, pairs, max_edges)
    heads = _ways(table, starts, best.select(F.col("_start").alias("set"), "hub", F.col("d1").alias("d")), "out")
    tails = _ways(table, ends, best.select(F.col("_end").alias("set"), "hub", F.col("d2").alias("d")), "in")
    at = at.join(heads.select(F.col("id").alias("start"), "hub", F.col("path").alias("head")), ["start", "hub"], "left")
    at = at.join(tails.select(F.col("id").alias("end"), "hub", F.slice(F.reverse("path"), F.lit(2), F.size("path")).alias("tail")), ["end", "hub"], "left")
    return at.select("start", "end", "d", F.when(F.col("d") == 0, F.array("start")).otherwise(F.concat("head", "tail")).alias("path"))
