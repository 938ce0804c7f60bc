"""Whole-graph metrics (GRA-14..16): components, clustering, diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Levels, materialise

#: Nodes whose distances to all others are worked out in the first round, and how many times more in each round after it.
SOURCES, GROWTH = 8, 8
#: Rows (pairs of a tried node and another) that a round holds at most, if a graph has no more than ROWS / SOURCES nodes.
ROWS = 4_000_000


def clean_relations(edges: DataFrame) -> DataFrame:
    """Edges without blank or placeholder ends."""
    bad = ("", "<unknown>", "null")
    return edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).where(~F.trim("source").isin(*bad, "undefined_target") & ~F.trim("target").isin(*bad))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (its smallest id): labels spread over edges and are shortcut until none changes."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    both = materialise(both.union(both.select("b", "a")).distinct(), "both-ways")
    state = materialise(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    for _ in range(rounds):
        seen = both.join(state, both.b == state.id).groupBy("a").agg(F.min("component").alias("near"))
        moved = state.join(seen, state.id == seen.a, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("m"))
        # follow the label's own label: halves the distance left
        jump = moved.select(F.col("id").alias("m"), F.col("m").alias("further"))
        new = materialise(moved.join(jump, "m", "left").select("id", F.least("m", F.coalesce("further", "m")).alias("component")), "labels")
        changed = new.join(state.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        state = new
        if changed:
            return state
    raise RuntimeError(f"components: not stable after {rounds} rounds")


def grown_components(labels: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component after a batch of nodes (id) and edges came to labels (id, component), the result for what was there.

    The batch is contracted to links between components, so the rounds run over the batch alone; the
    labels are read once to name its ends and once to take their new names. Only added edges are
    handled: a deletion needs components() over what is left. Edges with an end in neither labels nor
    nodes don't count; a batch that is run again changes nothing.
    """
    fresh = nodes.select("id").where("id IS NOT NULL").distinct().join(labels.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    known = labels.select("id", "component").unionByName(fresh)
    links = edges.select("source", "target").where("source <> target").distinct()
    for end in ("source", "target"):
        links = links.join(known.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
    links = materialise(links.select(F.col("_source").alias("source"), F.col("_target").alias("target")).where("source <> target").distinct(), "contracted")
    roots = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    moved = components(roots, links, rounds).where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("_further"))
    return known.join(moved, "component", "left").select("id", F.coalesce("_further", "component").alias("component"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient of the undirected simple graph.

    Each triangle is found once, from its two ends of lowest (degree, id) order, so a hub's pairs of
    neighbours are never listed.
    """
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    e = materialise(e, "simple")
    deg = materialise(e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")), "degree")
    da, db = deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    up = e.join(da, "a").join(db, "b")
    flip = F.struct("db", "b") < F.struct("da", "a")
    up = materialise(up.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("v")), "oriented")
    x, y = up.select("u", F.col("v").alias("p")), up.select("u", F.col("v").alias("q"))
    wedges = x.join(y, "u").where("p < q")
    closed = up.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    tri = wedges.join(closed, ["p", "q"]).select(F.explode(F.array("u", "p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = deg.join(tri, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("coefficient", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def distances(both: DataFrame, starts: DataFrame) -> DataFrame:
    """start, id, d of all nodes reached from starts (start) over edges given in both directions."""
    spark = both.sparkSession
    levels = Levels(spark, starts.select("start", F.col("start").alias("id"), F.lit(0).alias("d")))
    while True:
        new = levels.last.join(both, F.col("id") == F.col("source")).select("start", F.col("target").alias("id")).distinct()
        if not levels.add(new.join(levels.all.select("start", "id"), ["start", "id"], "left_anti").withColumn("d", F.lit(levels.n))):
            return levels.all


def _twins(both: DataFrame) -> DataFrame:
    """id, twin of the nodes of both (source, target, both ways): twin is the smallest node with exactly the same neighbours."""
    marks = both.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(seed), F.col("target")).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)))
    marks = materialise(marks, "marks")
    like = materialise(marks.join(marks.groupBy("n", "h1", "h2").agg(F.min("id").alias("twin")), ["n", "h1", "h2"]).select("id", "twin", "n"), "alike")
    # equal marks are held against the neighbours themselves
    asked = both.join(like.where("id <> twin"), F.col("source") == F.col("id")).select("id", "twin", "n", "target")
    shared = asked.join(both.select(F.col("source").alias("twin"), "target"), ["twin", "target"]).groupBy("id", "twin", "n").agg(F.count("*").alias("m"))
    held = shared.where("m = n").select("id", F.col("twin").alias("_held"))
    return materialise(like.select("id").join(held, "id", "left").select("id", F.coalesce("_held", "id").alias("twin")), "twins")


def diameter(nodes: DataFrame, edges: DataFrame) -> int | None:
    """Longest shortest path of a connected undirected graph; None if it isn't connected, 0 without nodes.

    Nodes with the same neighbours are two steps from each other and as far from any other node, so one
    of them stands for all. Distances from a few nodes bound every node's longest one from both sides; nodes that can't be
    above the best known are done with. Each round tries GROWTH times as many nodes as the one before, while a
    table holds at most ROWS rows, so that graphs in which all nodes are alike take few rounds too.
    """
    ids = materialise(nodes.select("id").distinct(), "nodes")
    both = edges.select("source", "target").where("source <> target")
    both = materialise(both.union(both.select("target", "source")).distinct(), "both-ways")
    both = both.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    if not both.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").isEmpty():
        return None
    n = ids.count()
    if n < 2:
        return 0
    both = materialise(both, "both-ways")
    twins = _twins(both)
    if not ids.join(twins, "id", "left_anti").isEmpty():
        return None
    open_ = ids.join(twins.where("id = twin"), "id").select("id")
    kept = open_.count()
    best = 2 if kept < n else 0
    if kept < n:
        # a neighbour of a node is a neighbour of its twins, so links between the nodes kept are all that count
        both = both.join(open_.withColumnRenamed("id", "source"), "source", "left_semi").join(open_.withColumnRenamed("id", "target"), "target", "left_semi")
        both, n = materialise(both, "both-ways"), kept
    open_ = materialise(open_.withColumns({"low": F.lit(best), "high": F.lit(n)}), "bounds")
    sources, most = SOURCES, max(SOURCES, ROWS // n)
    while not open_.isEmpty():
        far = open_.orderBy(F.desc("high"), "low", "id").limit(sources // 2)
        near = open_.orderBy("low", F.desc("high"), "id").limit(sources - sources // 2)
        starts = materialise(far.union(near).select(F.col("id").alias("start")).distinct(), "starts")
        d = distances(both, starts)
        longest = materialise(d.groupBy("start").agg(F.max("d").alias("longest"), F.count("*").alias("n")), "longest")
        if not longest.where(F.col("n") != n).isEmpty():
            return None
        best = max(best, longest.agg(F.max("longest")).first()[0])
        bound = d.join(longest, "start").groupBy("id").agg(F.max(F.greatest("d", F.col("longest") - F.col("d"))).alias("l"), F.min(F.col("longest") + F.col("d")).alias("h"))
        tight = materialise(open_.join(bound, "id").select("id", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high")), "bounds")
        best = max(best, tight.agg(F.max("low")).first()[0])
        open_ = materialise(tight.where(F.col("high") > best), "bounds")
        sources = min(sources * GROWTH, most)
    return best
