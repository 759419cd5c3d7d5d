"""A reachability index: strong components, and for each the intervals of the goals that it reaches.

Nodes are condensed to their strong components, so what is left has no cycles. In each of several random orders every
component has a number, in the order of a walk down a random spanning forest: the hashes of its first ancestors there, so
that what hangs together lies together. A component's interval in an order runs from the least to the largest number of the
goals that it reaches. Whoever is reached from a component has a number inside its intervals; the converse is checked by a
walk, which the intervals keep short: edges into components without any goal are not even kept, and a walk to a given goal
only enters components whose intervals hold the goal's numbers.

Building takes as many rounds as the longest path has edges; each only passes on the intervals that have changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, endpoints
from ..runtime import broadcast_if_small, cut, tabled
from ..schema import UPSTREAM_EDGES
from .traverse import BROADCAST_IDS, reversed_edges, strong_components

#: Ancestors whose hashes make a number, and the bits of each; the first needs most, as it tells the trees apart.
_BITS = (31, 8, 8, 8, 8)
#: Seeds that share a number as its bits.
_SEEDS = 63


@dataclass(frozen=True)
class ReachIndex:
    """nodes: id, node (its component); labels: node, spans (an interval (low, high) for each order) of those that reach a
    goal; edges: source, target, spans of the target, only of targets that reach a goal; goals: id, node, at (its numbers); orders: how many there are."""

    nodes: DataFrame
    labels: DataFrame
    edges: DataFrame
    goals: DataFrame
    orders: int


def _numbers(nodes: DataFrame, edges: DataFrame, orders: int) -> DataFrame:
    """(node, at): a number in each order, from the hashes of the first ancestors in a random spanning forest."""
    parent = [F.min_by("source", F.xxhash64(F.lit(k), "source", "target")).alias(f"p{k}") for k in range(orders)]
    parents = edges.groupBy(F.col("target").alias("node")).agg(*parent)
    tree = nodes.join(parents, "node", "left").select("node", F.posexplode(F.array(*[f"p{k}" for k in range(orders)])).alias("k", "parent"))
    own = lambda bits: F.shiftrightunsigned(F.xxhash64(F.col("k") + 100, "node"), 64 - bits)
    placed = cut(tree.select("node", "k", "parent", F.when(F.col("parent").isNull(), F.shiftleft(own(_BITS[0]), sum(_BITS[1:]))).alias("at")))
    left = sum(_BITS[1:])
    for bits in _BITS[1:]:  # a node below the last level has the number of its ancestor there
        left -= bits
        above = placed.where("at is not null").select(F.col("node").alias("parent"), "k", F.col("at").alias("above"))
        placed = cut(placed.join(above, ["parent", "k"], "left").select("node", "k", "parent", F.coalesce("at", F.col("above") + F.shiftleft(own(bits), left)).alias("at")))
    at = F.coalesce("at", F.shiftrightunsigned(F.xxhash64("k", "parent"), 1))
    return placed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", at.alias("at")))), lambda x: x["at"]).alias("at"))


def build(edges: DataFrame, goals: DataFrame, orders: int = 3) -> ReachIndex:
    """The index of edges (source, target) towards goals (id). Goals without edges reach themselves."""
    edges = edges.select("source", "target").where("source <> target")
    # Edges into dead ends that are no goals go at once; what is left is derived and made distinct once for all steps.
    alive = edges.select(F.col("source").alias("target")).union(goals.select("id")).distinct()
    edges = cut(edges.join(alive, "target", "left_semi").select("source", "target").distinct())
    strong = cut(strong_components(edges, distinct=True))
    ids = cut(endpoints(edges).union(goals.select("id")).distinct())
    nodes = cut(ids.join(strong, "id", "left").select("id", F.coalesce("component", "id").alias("node"))) if strong.take(1) else ids.select("id", F.col("id").alias("node"))
    to = lambda end: nodes.select(F.col("id").alias(end), F.col("node").alias(f"_{end}"))
    between = edges if not strong.take(1) else edges.join(to("source"), "source").join(to("target"), "target").select(F.col("_source").alias("source"), F.col("_target").alias("target")).where("source <> target").distinct()
    between = between if between is edges else cut(between)
    numbers = _numbers(nodes.select("node").distinct(), between, orders)
    ends = cut(goals.select("id").distinct().join(nodes, "id").join(numbers, "node").select("id", "node", "at"))
    # min and max of the numbers of all goals that a node reaches: what changed in a round is passed on to the nodes before it.
    low = [F.min(F.get("low", F.lit(k))) for k in range(orders)]
    high = [F.max(F.get("high", F.lit(k))) for k in range(orders)]
    merged = lambda df: df.groupBy("node").agg(F.array(*low).alias("low"), F.array(*high).alias("high"))
    labels = changed = cut(merged(ends.select("node", F.col("at").alias("low"), F.col("at").alias("high"))))
    while changed.take(1):
        came = between.join(changed.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), "low", "high")
        new = merged(labels.unionByName(came)).join(labels.select("node", F.col("low").alias("_low"), F.col("high").alias("_high")), "node", "left")
        new = cut(new.withColumn("moved", ~(F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high")))).select("node", "low", "high", "moved"))
        labels, changed = new.drop("moved"), new.where("moved").drop("moved")
    labels = labels.select("node", F.arrays_zip("low", "high").alias("spans"))
    kept = cut(between.join(labels.withColumnRenamed("node", "target"), "target").select("source", "target", "spans"))
    return ReachIndex(nodes, labels, kept, ends, orders)


def _inside(at: str, spans: str):
    return F.forall(F.arrays_zip(F.col(at).alias("at"), F.col(spans).alias("span")), lambda x: x["at"].between(x["span"]["low"], x["span"]["high"]))


def goals_of(index: ReachIndex, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id): each goal that each seed (id) reaches, itself included. Only nodes that lead to a goal are walked.

    max_depth bounds the edges of a walk; it counts within the condensed graph, so it wants a graph without cycles."""
    known = seeds.select(F.col("id").alias("seed")).distinct().join(index.nodes.withColumnRenamed("id", "seed"), "seed").join(index.labels.select("node"), "node", "left_semi")
    seen = frontier = cut(known.select("seed", "node"))
    depth = 0
    while frontier.take(1) and (max_depth is None or depth < max_depth):
        found = frontier.join(index.edges, frontier["node"] == index.edges["source"]).select("seed", F.col("target").alias("node")).distinct()
        frontier = cut(found.join(seen, ["seed", "node"], "left_anti"))
        seen, depth = seen.union(frontier), depth + 1
        if depth % 16 == 0:
            seen = cut(seen)
    return seen.join(index.goals.select("id", "node"), "node").select("seed", "id")


def reached_pairs(index: ReachIndex, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (seed, id) whose seed reaches the goal id. Intervals refuse most of the others without a walk.

    All pairs of a seed share its walk, which enters a component only if the component's interval, in every order, meets the
    range of the numbers that the seed's goals have; so a walk is as long as the seed's own and not once that for each pair."""
    asked = pairs.select("seed", "id").distinct().join(index.goals.select("id", F.col("node").alias("goal"), "at"), "id")
    asked = asked.join(index.nodes.select(F.col("id").alias("seed"), "node"), "seed").join(index.labels, "node").where(_inside("at", "spans"))
    asked = cut(asked.select("seed", "id", "goal", "at", "node"))
    places = range(index.orders)
    ends = [c for k in places for c in (F.min(F.get("at", F.lit(k))).alias(f"low{k}"), F.max(F.get("at", F.lit(k))).alias(f"high{k}"))]
    bounds = [f"{end}{k}" for k in places for end in ("low", "high")]
    meets = F.lit(True)
    for k in places:
        span = F.get("spans", F.lit(k))
        meets &= (span["low"] <= F.col(f"high{k}")) & (span["high"] >= F.col(f"low{k}"))
    frontier = cut(asked.groupBy("seed", "node").agg(*ends))
    seen, depth = frontier.select("seed", "node"), 0
    while frontier.take(1):
        steps = frontier.join(index.edges, frontier["node"] == index.edges["source"]).where(meets)
        found = steps.select("seed", F.col("target").alias("node"), *bounds).distinct()
        frontier = cut(found.join(seen, ["seed", "node"], "left_anti"))
        seen, depth = seen.union(frontier.select("seed", "node")), depth + 1
        if depth % 8 == 0:
            seen = cut(seen)
    return asked.select("seed", "id", "goal").join(seen, (asked["seed"] == seen["seed"]) & (asked["goal"] == seen["node"]), "left_semi").select("seed", "id")


def _numbered(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit): a place for each seed, `_SEEDS` to a block; seeds that follow each other share blocks."""
    numbered = tabled(seeds.select(F.col("id").alias("seed")).distinct().orderBy("seed").withColumn("no", F.monotonically_increasing_id()))
    return numbered.select("seed", F.floor(F.col("no") / _SEEDS).alias("block"), (F.col("no") % _SEEDS).cast("int").alias("bit"))


def _bit():
    return F.expr("shiftleft(1L, bit)")


def _seeds_of_goals(edges: DataFrame, numbered: DataFrame, goals: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, block, bits): of each goal (id) the seeds that reach it over at most `max_depth` edges, as bits of their blocks; in
    several rows where they came in several rounds. Goals aren't left again.

    A node holds the seeds that reach it as bits of a number, `_SEEDS` of them in a row, so a walk of all seeds moves a row a
    node and block and not one for each seed and node. Edges into dead ends that are no goals go first."""
    goals = tabled(goals.select("id").distinct())
    edges = tabled(edges.select("source", "target").where("source <> target"))
    alive = edges.select(F.col("source").alias("target")).union(goals.toDF("target")).distinct()
    edges = tabled(edges.join(alive, "target", "left_semi").select("source", "target"))
    marked = lambda df: tabled(df.join(goals.withColumn("goal", F.lit(True)), "id", "left").select("id", "block", "bits", F.coalesce("goal", F.lit(False)).alias("goal")))
    seen = frontier = marked(numbered.select(F.col("seed").alias("id"), "block", _bit().alias("bits")))
    depth = 0
    while (max_depth is None or depth < max_depth) and frontier.take(1):
        going = broadcast_if_small(frontier.where("not goal").select("id", "block", "bits"), BROADCAST_IDS)
        found = edges.join(going, edges["source"] == going["id"]).groupBy(F.col("target").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
        held = seen.groupBy("id", "block").agg(F.bit_or("bits").alias("_held"))
        new = found.join(held, ["id", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("long")))))
        frontier = marked(new.where("bits <> 0").select("id", "block", "bits"))
        seen, depth = seen.union(frontier), depth + 1
        if depth % 16 == 0:
            seen = tabled(seen)
    return seen.where("goal").select("id", "block", "bits")


def _listed(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(seed, id): the seeds of each id by their bits."""
    each = sets.select("id", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(_SEEDS - 1)), lambda i: F.getbit("bits", i) == 1)).alias("bit"))
    return each.join(broadcast_if_small(numbered), ["block", "bit"]).select("seed", "id")


def goals_by_sets(edges: DataFrame, seeds: DataFrame, goals: DataFrame, max_depth: int) -> DataFrame:
    """(seed, id): each goal (id) that each seed (id) reaches over at most `max_depth` edges, itself included; goals aren't
    left again. No index is made."""
    numbered = _numbered(seeds)
    return _listed(_seeds_of_goals(edges, numbered, goals, max_depth), numbered)


def pairs_by_sets(edges: DataFrame, pairs: DataFrame, goals: DataFrame) -> DataFrame:
    """Those of the pairs (seed, id) whose seed reaches the goal id, itself included; goals aren't left again. No index is made:
    where the seeds of the pairs are many, one walk of all moves less than an index and the walks that it leaves. The pairs of a
    goal are bits of its blocks as well, so a seed and a goal stand in a row of their own only where the pair is found."""
    pairs = tabled(pairs.select("seed", "id"))
    numbered = _numbered(pairs.select(F.col("seed").alias("id")))
    asked = pairs.join(broadcast_if_small(numbered), "seed").groupBy("id", "block").agg(F.bit_or(_bit()).alias("bits"))
    reached = _seeds_of_goals(edges, numbered, goals, None).groupBy("id", "block").agg(F.bit_or("bits").alias("_reached"))
    both = asked.join(reached, ["id", "block"]).select("id", "block", F.col("bits").bitwiseAND(F.col("_reached")).alias("bits"))
    return _listed(both.where("bits <> 0"), numbered)


def page_pairs(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (seed, id) of a node and a page of which a change of the node affects the page."""
    edges = reversed_edges(graph.edges.where(F.col("type").isin(*UPSTREAM_EDGES)))
    return pairs_by_sets(edges, pairs, graph.nodes.where("type = 'page'"))


def page_index(graph: Graph) -> ReachIndex:
    """Towards pages, against the direction of calls. Pages are not passed through, as nothing leaves them here."""
    pages = graph.nodes.where("type = 'page'").select("id")
    edges = reversed_edges(graph.edges.where(F.col("type").isin(*UPSTREAM_EDGES)))
    return build(edges.join(pages.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target"), pages)


def affected_pages_of(graph: Graph, ids: DataFrame, max_depth: int = 10, index: ReachIndex | None = None) -> DataFrame:
    """(seed, id): the pages that a change of each of the nodes `ids` affects, all at once; a page isn't its own. Without an
    index none is made, as that takes far more than one walk."""
    if index is not None:
        return goals_of(index, ids.select("id").join(graph.nodes.select("id"), "id", "left_semi"), max_depth + 1).where("seed <> id")
    seeds = graph.nodes.select("id").join(broadcast_if_small(ids.select("id").distinct(), BROADCAST_IDS), "id", "left_semi")
    edges = reversed_edges(graph.edges.where(F.col("type").isin(*UPSTREAM_EDGES)))
    return goals_by_sets(edges, seeds, graph.nodes.where("type = 'page'"), max_depth + 1).where("seed <> id")
