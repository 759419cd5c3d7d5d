"""Traversals as rounds of joins, those whose result depends on the order of a walk included.

A round joins the frontier to the edges and drops what was visited before; its result is checkpointed, so the lineage stays
short and a lost executor costs one round. Cycles end by the visited set, chains by the given bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import trace_layer
from ..graph import Graph, endpoints
from ..runtime import broadcast_if_small, cut, small, tabled
from ..schema import DATA_EDGES, LINK_EDGES, ROUTE_TYPES, TEST_TYPES, UPSTREAM_EDGES
from .lookup import find_any, find_by_file, find_by_route, induced, ranked_first

PARENT_ROUTE_DEPTH = 64
TRACE_STEPS = 64
SUBTREE_DEPTH = 1000
#: Up to so many ids (some 50 bytes each) are broadcast to test the ends of edges; more are joined by shuffles.
BROADCAST_IDS = 500_000
#: Steps of a trace that are looked up node by node, before the first steps of all nodes are made.
LOOKUP_ROUNDS = 6


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(id, depth): what edges (source, target) reach from seeds (id), the seeds at depth 0, each at its least depth.

    Ids in `stop` are reached but not left again. The edges are neither copied nor made distinct: a round reads two columns of
    them, and the few rows that meet the frontier are made distinct after the join."""
    edges = edges.select("source", "target")
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        going = frontier if stop is None or not depth else frontier.join(stop, "id", "left_anti")
        found = going.join(edges, going["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        depth += 1
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.union(frontier)
        if depth % 16 == 0:
            seen = cut(seen)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def affected_pages(graph: Graph, id_: str, max_depth: int = 10) -> DataFrame:
    """Pages that reach a node over calls, handlers, services and queries. Pages are not passed through; nodes at the last
    depth are expanded once more."""
    edges = reversed_edges(graph.edges.where(F.col("type").isin(*UPSTREAM_EDGES)))
    pages = graph.nodes.where("type = 'page'").select("id")
    seeds = graph.nodes.where(F.col("id") == id_).select("id")
    found = reach(edges, seeds, max_depth + 1, stop=pages).where(F.col("id") != id_)
    return graph.nodes.where("type = 'page'").join(found, "id")


def subtrees(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, parent_id, depth, dfs_ord): for each root (id) the tree of a depth-first walk down to `depth`, in which a node
    hangs where the walk comes to it first; at the last depth nodes are claimed but not left.

    The walk claims a node by the least path, in the order of edges, along which all nodes before it are claimed the same way.
    So each round gives every node the least of its parents' paths that don't hold it already, from the paths of the round
    before. Taken in the walk's own order, a node is right one round after all before it are, and a false path never comes
    before the right one for good; so the rounds end, and they end with the walk's tree. All roots go at once.

    Edges (source, target, ord) with an unknown end are left out; of repeated ones the first counts, of equal places the
    smaller id. Places in the walk are counted within ranges of the sorted paths, so no tree is sorted by one task."""
    known = nodes.select("id").distinct()
    edges = edges.where("source <> target").select("source", "target", "ord")
    edges = cut(edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi"))
    step = F.struct(F.col("ord"), F.col("target").alias("id"))
    start = roots.select("id").distinct().join(known, "id", "left_semi").select(F.col("id").alias("root"), "id", F.array().cast(f"array<{edges.select(step.alias('s')).schema['s'].dataType.simpleString()}>").alias("path"))
    start = state = cut(start)
    moved = depth > 0
    while moved:
        ahead = state.where(F.size("path") < depth).join(edges, state["id"] == edges["source"])
        ahead = ahead.where((F.col("target") != F.col("root")) & ~F.exists("path", lambda x: x["id"] == F.col("target")))
        after = cut(start.unionByName(ahead.groupBy("root", F.col("target").alias("id")).agg(F.min(F.array_append("path", step)).alias("path"))))
        before = state.withColumnRenamed("path", "_before")
        moved = bool(after.join(before, ["root", "id"], "full_outer").where(~F.col("path").eqNullSafe(F.col("_before"))).take(1))
        state = after
    parent = F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)["id"]).when(F.size("path") == 1, F.col("root"))
    ranges = cut(state.repartitionByRange("root", "path").withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("root").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("root", "_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("root", "_range").orderBy("path")) - 1
    placed = ranges.withColumn("_place", place).join(first, ["root", "_range"])
    return placed.select("root", "id", parent.alias("parent_id"), F.size("path").alias("depth"), (F.col("_first") + F.col("_place")).cast("int").alias("dfs_ord"))


def subtree(graph: Graph, root: str, edge_type: str, depth) -> DataFrame:
    """(root, id, parent_id, depth, dfs_ord): the depth-first tree of one root over the edges of one type.

    Depth is held in 0 to 1000, anything that is no number counts as 0."""
    try:
        depth = int(min(max(float(depth), 0), SUBTREE_DEPTH))
    except (TypeError, ValueError, OverflowError):
        depth = 0
    return subtrees(graph.nodes, graph.edges.where(F.col("type") == edge_type), graph.nodes.where(F.col("id") == root), depth)


def component_tree(graph: Graph, query: str, depth: int = 3) -> DataFrame:
    """The rendered tree under a node found by route, else by file."""
    found = find_by_route(graph, query).take(1) or find_by_file(graph, query).take(1)
    return subtree(graph, found[0]["id"] if found else "", "renders", depth)


def find_callers(graph: Graph, query: str) -> tuple[DataFrame, DataFrame]:
    """(direct callers, affected pages) of a node found by route, file or name."""
    from .joins import upstream

    found = find_any(graph, query).take(1)
    id_ = found[0]["id"] if found else ""
    return upstream(graph, id_, UPSTREAM_EDGES), affected_pages(graph, id_)


def parent_routes(graph: Graph, callers: DataFrame) -> DataFrame:
    """(caller, route): for each caller itself if it is a route; else the routes that handle it; only where there are none,
    the routes of the services' callers, and so on for up to 64 rounds.

    All callers go at once; each keeps its own visited set, so diamonds and cycles end."""
    routes = graph.nodes.where(F.col("type").isin(*ROUTE_TYPES)).select(F.col("id").alias("route"))
    known = graph.nodes.select(F.col("id").alias("source"))
    handled = graph.edges.where("type = 'handles'").select(F.col("source").alias("route"), F.col("target").alias("at")).join(routes, "route", "left_semi").distinct()
    handled = cut(handled.join(routes.select(F.col("route").alias("at")), "at", "left_anti").union(routes.select("route", F.col("route").alias("at")).select("at", "route")))
    calls = cut(graph.edges.where("type = 'calls_service'").join(known, "source", "left_semi").select(F.col("target").alias("at"), F.col("source").alias("next")).distinct())
    seen = cut(callers.select(F.col("id").alias("caller"), F.col("id").alias("at")).distinct())
    frontier, out = seen, None
    for depth in range(1, PARENT_ROUTE_DEPTH + 1):
        hit = frontier.join(handled, "at").select("caller", "route").distinct()
        out = hit if out is None else out.union(hit)
        more = frontier.join(handled.select("at").distinct(), "at", "left_anti").join(calls, "at").select("caller", F.col("next").alias("at")).distinct()
        frontier = cut(more.join(seen, ["caller", "at"], "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.union(frontier)
        if depth % 16 == 0:
            seen = cut(seen)
    return out.distinct()


def model_flows(graph: Graph, models: DataFrame | None = None) -> DataFrame:
    """Flow edges of all models, or of the given ones (id): model_id, from_id, to_id, transfer_method."""
    models = (graph.nodes.where("type = 'db_model'") if models is None else models).select(F.col("id").alias("model_id"))
    queries = graph.edges.where("type = 'queries_db'").select(F.col("target").alias("model_id"), F.col("source").alias("caller"))
    queries = queries.join(models, "model_id", "left_semi").join(graph.nodes.select(F.col("id").alias("caller")), "caller", "left_semi").select("model_id", "caller")
    parents = parent_routes(graph, queries.select(F.col("caller").alias("id")))
    routes = cut(queries.join(parents, "caller").select("model_id", "route").distinct())
    handlers = graph.edges.where("type = 'handles'").select(F.col("source").alias("route"), F.col("target").alias("handler"))
    users = api_callers(graph)
    return (
        queries.select("model_id", F.col("model_id").alias("from_id"), F.col("caller").alias("to_id"), F.lit("prisma_result").alias("transfer_method"))
        .unionByName(routes.join(handlers, "route").select("model_id", F.col("handler").alias("from_id"), F.col("route").alias("to_id"), F.lit("return_type").alias("transfer_method")))
        .unionByName(routes.join(users, "route").select("model_id", F.col("route").alias("from_id"), F.col("component").alias("to_id"), F.lit("hook_data").alias("transfer_method")))
    )


def api_callers(graph: Graph) -> DataFrame:
    """(route, component) of calls that components make; one row for each edge."""
    components = graph.nodes.where("type = 'component'").select(F.col("id").alias("component"))
    calls = graph.edges.where("type = 'calls_api'").select(F.col("target").alias("route"), F.col("source").alias("component"))
    return calls.join(components, "component", "left_semi").select("route", "component")


def model_totals(graph: Graph) -> DataFrame:
    """model_id, total_routes, total_components of every model. Routes are counted before they meet the components."""
    models = graph.nodes.where("type = 'db_model'").select(F.col("id").alias("model_id"))
    queries = graph.edges.where("type = 'queries_db'").select(F.col("target").alias("model_id"), F.col("source").alias("caller"))
    parents = parent_routes(graph, queries.select(F.col("caller").alias("id")).distinct())
    routes = cut(queries.join(parents, "caller").select("model_id", "route").distinct())
    pairs = routes.join(api_callers(graph).distinct(), "route").select("model_id", "component").distinct()
    n_routes = routes.groupBy("model_id").agg(F.count("*").alias("total_routes"))
    n_components = pairs.groupBy("model_id").agg(F.count("*").alias("total_components"))
    return models.join(n_routes, "model_id", "left").join(n_components, "model_id", "left").na.fill(0, ["total_routes", "total_components"])


def flow_edges(flows: DataFrame, models: DataFrame) -> DataFrame:
    """Flow rows as `data_flows_to` edges; the type name is part of the id only."""
    named = flows.join(models.select(F.col("id").alias("model_id"), F.col("name").alias("type_name")), "model_id")
    target = F.concat_ws(":", "to_id", "type_name")
    metadata = F.to_json(F.struct(F.col("type_name").alias("typeName"), F.col("transfer_method").alias("transferMethod")))
    return named.select(
        F.concat_ws("--", "from_id", F.lit("data_flows_to"), target).alias("id"), F.col("from_id").alias("source"), F.col("to_id").alias("target"),
        F.lit("data_flows_to").alias("type"), F.lit("inferred").alias("confidence"), metadata.alias("metadata"),
    )


def _known_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): those of the ids (one column, id) that are nodes."""
    return nodes.select("id").join(broadcast_if_small(ids.distinct(), BROADCAST_IDS), "id", "left_semi").distinct()


def _first_steps(steps: DataFrame, nodes: DataFrame, here: DataFrame) -> DataFrame:
    """(at, to, via): the first of the steps (at, to, ord, via) from each node `here` (at) to a known node, null if none is.

    Edges that lead nowhere are few: only nodes whose first one does have all their steps looked up among the nodes."""
    least = F.min(F.struct("ord", "via", "to")).alias("s")
    first = cut(steps.join(here, "at").groupBy("at").agg(least).select("at", "s.to", "s.via"))
    good = cut(first.join(_known_of(nodes, first.select(F.col("to").alias("id"))).toDF("to"), "to", "left_semi").select("at", "to", "via"))
    lost = cut(first.join(good, "at", "left_anti").select("at"))
    if lost.take(1):
        more = cut(steps.join(broadcast_if_small(lost, BROADCAST_IDS), "at").groupBy("at", "to").agg(F.min(F.struct("ord", "via")).alias("o")).select("at", "to", "o.ord", "o.via"))
        more = more.join(_known_of(nodes, more.select(F.col("to").alias("id"))).toDF("to"), "to", "left_semi").groupBy("at").agg(least)
        good = good.union(more.select("at", "s.to", "s.via"))
    return here.join(good, "at", "left").select("at", "to", "via")


def _first_choices(steps: DataFrame, nodes: DataFrame, done: DataFrame | None, here: DataFrame) -> tuple[DataFrame, bool]:
    """(first steps, whether they are those of all nodes): `done`, and those of all nodes that first steps from `here` (at) lead to.

    Short walks from few nodes take a round a step, each a pass over the edges that shuffles next to nothing. After that many
    rounds, or from more nodes than are broadcast, the first steps of all nodes are made at once."""
    fresh = here.distinct()
    for _ in range(LOOKUP_ROUNDS):
        fresh = cut(fresh if done is None else fresh.join(done, "at", "left_anti"))
        if done is not None and not fresh.take(1):
            return done, False
        if not small(fresh, BROADCAST_IDS):
            break
        found = tabled(_first_steps(steps, nodes, F.broadcast(fresh)))
        done = found if done is None else done.union(found)
        fresh = found.where("to is not null").select(F.col("to").alias("at")).distinct()
    known = steps.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    return cut(known.groupBy("at").agg(F.min(F.struct("ord", "via", "to")).alias("s")).select("at", "s.to", "s.via")), True


def _paths(first: DataFrame, most: int) -> DataFrame:
    """(at, path): the (to, via) that first steps (at, to, via) lead over from each node, `most` of them at least where the
    walk is that long.

    Paths double: each takes on the path of its own end, so the rounds are the logarithm of the longest walk. A walk that
    has run into a circle goes round it. Only paths that may still grow are written again."""
    going = cut(first.where("to is not null").select("at", F.array(F.struct("to", "via")).alias("path")))
    done, length = going.limit(0), 1
    while length < most and going.take(1):
        rest = done.union(going).select(F.col("at").alias("_end"), F.col("path").alias("_rest"))
        grown = going.withColumn("_end", F.element_at("path", -1)["to"]).join(rest, "_end", "left")
        grown = cut(grown.select("at", F.when(F.col("_rest").isNull(), F.col("path")).otherwise(F.concat("path", "_rest")).alias("path")))
        length *= 2
        done, going = done.union(grown.where(F.size("path") < length)), grown.where(F.size("path") == length)
    return done.union(going)


def _walks(walkers: DataFrame, steps: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """walkers (root, at, seen, vias, left, ups) after they have gone as far as they can by the steps (at, to, ord, via): seen
    holds the nodes in order, vias the types of the edges between them.

    A walk follows first choices up to a node it has seen; there, in a repair round, it takes its first step to another one
    and follows the first choices from there. Walks that meet nothing of their own end in the first round."""
    first, whole, paths, done = None, False, None, None
    while True:
        before = first
        if not whole:
            first, whole = _first_choices(steps, nodes, first, walkers.where("left > 0").select("at"))
        if first is not before:
            paths = _paths(first, most)
        none = F.array().cast("array<struct<to:string,via:string>>")
        ahead = walkers.join(paths, "at", "left").withColumn("path", F.slice(F.coalesce("path", none), F.lit(1), F.col("left")))
        ahead = ahead.withColumn("ids", F.transform("path", lambda x: x["to"]))
        met = F.filter(F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1))), lambda i: F.array_contains("seen", F.get("ids", i - 1)) | (F.array_position("ids", F.get("ids", i - 1)) < i))
        ahead = ahead.withColumn("met", F.get(met, F.lit(0))).withColumn("good", F.when(F.col("met").isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), F.col("met") - 1)))
        moved = ahead.select(
            "root", F.coalesce(F.get("good", F.size("good") - 1)["to"], F.col("at")).alias("at"), F.concat("seen", F.transform("good", lambda x: x["to"])).alias("seen"),
            F.concat("vias", F.transform("good", lambda x: x["via"])).alias("vias"), (F.col("left") - F.size("good")).alias("left"), "ups", F.col("met").isNotNull().alias("stuck"),
        )
        moved = cut(moved)
        stuck = moved.where("stuck and left > 0")
        ended = moved.where("not stuck or left = 0").drop("stuck")
        done = ended if done is None else done.unionByName(ended)
        if not stuck.take(1):
            return done
        turns = cut(steps.join(broadcast_if_small(stuck.select("at").distinct(), BROADCAST_IDS), "at").groupBy("at", "to").agg(F.min(F.struct("ord", "via")).alias("o")))
        turns = turns.join(_known_of(nodes, turns.select(F.col("to").alias("id"))).toDF("to"), "to", "left_semi")
        turn = stuck.join(turns, "at").where(~F.array_contains("seen", F.col("to"))).groupBy("root").agg(F.min(F.struct("o", "to")).alias("next"))
        turned = cut(stuck.drop("stuck").join(turn, "root", "left"))
        done = done.unionByName(turned.where("next is null").drop("next"))
        to = F.col("next.to")
        walkers = turned.where("next is not null").select("root", to.alias("at"), F.array_append("seen", to).alias("seen"), F.array_append("vias", F.col("next.o.via")).alias("vias"), (F.col("left") - 1).alias("left"), "ups")


def linear_traces(graph: Graph, roots: DataFrame, steps: int = TRACE_STEPS) -> DataFrame:
    """For each root (id) the main path through it: root, index, node_id, name, type, edge_from_prev, layer.

    From the root upstream, then downstream, each step takes the first link edge to a node not yet on the path; both ways
    share one budget, upstream first. All roots go at once, by doubled paths of first choices."""
    # A table and no checkpoint: ids of one kind compress well, and a pass reads only the columns it uses.
    edges = tabled(graph.edges.where(F.col("type").isin(*LINK_EDGES) & (F.col("source") != F.col("target"))).select("source", "target", "ord", F.col("type").alias("via")))
    one_way = lambda at, to: edges.select(F.col(at).alias("at"), F.col(to).alias("to"), "ord", "via")
    known = cut(_known_of(graph.nodes, roots.select("id")))
    walkers = known.select(F.col("id").alias("root"), F.col("id").alias("at"), F.array("id").alias("seen"), F.array().cast("array<string>").alias("vias"), F.lit(steps - 1).alias("left"), F.lit(1).alias("ups"))
    up = _walks(walkers, one_way("target", "source"), graph.nodes, steps - 1)
    up = up.select("root", F.col("root").alias("at"), "seen", "vias", "left", F.size("seen").alias("ups"))
    both = _walks(up, one_way("source", "target"), graph.nodes, steps - 1)
    # seen: the root, its nodes upstream from near to far, then those downstream.
    ahead, after = F.col("ups"), F.size("seen")
    order = F.concat(F.reverse(F.slice("seen", F.lit(1), ahead)), F.slice("seen", ahead + 1, after))
    via = F.concat(F.array(F.lit(None).cast("string")), F.reverse(F.slice("vias", F.lit(1), ahead - 1)), F.slice("vias", ahead, after))
    out = both.select("root", F.posexplode(F.arrays_zip(order.alias("node_id"), via.alias("edge_from_prev"))).alias("place", "step"))
    out = cut(out.select("root", (F.col("place") + 1).alias("index"), "step.node_id", "step.edge_from_prev"))
    named = graph.nodes.select(F.col("id").alias("node_id"), "name", "type").join(broadcast_if_small(out.select("node_id").distinct(), BROADCAST_IDS), "node_id", "left_semi")
    return out.join(named, "node_id").select("root", "index", "node_id", "name", "type", "edge_from_prev", trace_layer("type").alias("layer"))


_TEXTS = {
    "page": "Page users open", "component": "Interface component", "api_route": "Entry point of the API", "trpc_procedure": "Remote procedure", "handler": "Handles the request",
    "service": "Business logic", "db_model": "Stored data", "module": "Group of sources",
}
_VIA = {"renders": "rendered by the step before", "calls_api": "called over the network", "handles": "handled here", "calls_service": "called for the logic", "queries_db": "queried"}


def explained(steps: DataFrame) -> DataFrame:
    """Trace steps with a sentence on each."""
    what = F.lit("Element of the code")
    for kind, text in _TEXTS.items():
        what = F.when(F.col("type") == kind, text).otherwise(what)
    how = F.lit(None).cast("string")
    for via, text in _VIA.items():
        how = F.when(F.col("edge_from_prev") == via, text).otherwise(how)
    return steps.withColumn("explanation", F.concat_ws(", ", F.concat(what, F.lit(" "), F.col("name")), how))


def strong_components(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, component): nodes of strongly connected components of two nodes or more, named by their smallest id.

    Rounds of colouring: each node takes the largest id that reaches it; a colour's own node, followed backwards within the
    colour, gives one component, which is then taken out. Nodes without edges in or out are trimmed first.

    distinct: the edges are known to be different, without loops and cheap to read again."""
    edges = edges if distinct else cut(edges.select("source", "target").where("source <> target").distinct())
    out = edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    n = edges.count()
    while True:
        while n:
            sources, targets = edges.select("source").distinct(), edges.select("target").distinct()
            edges, before = cut(edges.join(targets.withColumnRenamed("target", "source"), "source", "left_semi").join(sources.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target")), n
            n = edges.count()
            if n == before:
                break
        if not n:
            return out.join(out.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
        colour = cut(endpoints(edges).select("id", F.col("id").alias("c")))
        while True:
            came = edges.join(colour.select(F.col("id").alias("source"), "c"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("n"))
            changed = cut(colour.join(came, "id", "left").select("id", F.greatest("c", "n").alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("moved")))
            colour = changed.select("id", "c")
            if not changed.where("moved").take(1):
                break
        inside = cut(edges.join(colour.select(F.col("id").alias("source"), "c"), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("d")), "target").where("c = d").select("source", "target"))
        back = reach(reversed_edges(inside), colour.where("id = c").select("id")).select("id").join(colour, "id")
        done = cut(back.select("id", F.col("c").alias("component")))
        sizes = done.groupBy("component").count().where("count > 1").select("component")
        out = cut(out.union(done.join(sizes, "component", "left_semi").select("id", "component")))
        gone = done.select("id")
        edges = cut(edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target"))
        n = edges.count()


def nearest_layout(files: DataFrame, layouts: DataFrame, levels: int = 64) -> DataFrame:
    """(path, layout): the layout file in a path's folder or the nearest one above."""
    parts = F.split("path", "/")
    ups = F.explode(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(levels))))
    above = files.where(F.size(parts) > 1).select("path", ups.alias("up")).withColumn("folder", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - F.col("up")), "/"))
    at = layouts.select(F.col("path").alias("layout"), F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
    return ranked_first(above.join(at, "folder"), ["path"], "up", "layout").select("path", "layout")


def focus(graph: Graph, id_: str | None, scope: str | None = None) -> Graph:
    """A node with its neighbours, or all nodes of a directory scope with the edges among them. The whole graph where the
    node isn't known."""
    from ..functions.columns import directory_scope

    if scope is not None:
        at = directory_scope("file_path")
        return induced(graph, graph.nodes.where((at["leaf"] if "/" in scope else at["root"]) == scope).select("id"))
    if not id_ or not graph.nodes.where(F.col("id") == id_).take(1):
        return graph
    edges = graph.edges.where((F.col("source") == id_) | (F.col("target") == id_))
    ids = endpoints(edges).union(graph.nodes.where(F.col("id") == id_).select("id")).distinct()
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges)


def edge_view(graph: Graph, types) -> Graph:
    """Edges of some types and the nodes at their ends."""
    edges = graph.edges.where(F.col("type").isin(*types))
    return Graph(graph.nodes.join(endpoints(edges), "id", "left_semi"), edges)


def request_view(graph: Graph) -> Graph:
    return edge_view(graph, LINK_EDGES)


def data_view(graph: Graph) -> Graph:
    return edge_view(graph, DATA_EDGES)


def test_graph(graph: Graph, case_id: str | None = None) -> Graph:
    """All test nodes with their own edges, and coverage, of one case if given."""
    tests = graph.nodes.where(F.col("type").isin(*TEST_TYPES)).select("id")
    own = induced(Graph(graph.nodes, graph.edges.where("type in ('tests', 'uses_fixture')")), tests).edges
    covers = graph.edges.where("type = 'covers'")
    covers = covers.where(F.col("source") == case_id) if case_id else covers
    edges = own.unionByName(covers)
    return Graph(graph.nodes.join(endpoints(edges).union(tests).distinct(), "id", "left_semi"), edges)


def module_overview(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(modules, edges) by directory scope.

    modules: scope, child_count, child_types by path prefix; edges: source and target scope and type, one for each triple,
    within a scope none, plus `contains` from root to leaf."""
    from ..functions.columns import directory_scope, slashes

    at = graph.nodes.select("id", "type", directory_scope("file_path").alias("s"), slashes("file_path").alias("path"))
    scopes = at.select(F.explode(F.array("s.root", "s.leaf")).alias("scope")).distinct()
    # Every prefix of a path may be a scope: nodes meet scopes by equality.
    parts = F.split("path", "/")
    prefixes = at.select("type", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("scope"))
    inside = prefixes.groupBy("scope").agg(F.count("*").alias("child_count"), F.sort_array(F.collect_set("type")).alias("child_types"))
    modules = scopes.join(inside, "scope", "left").select("scope", F.coalesce("child_count", F.lit(0)).alias("child_count"), F.coalesce("child_types", F.array().cast("array<string>")).alias("child_types"))
    leaf = at.select("id", F.col("s.leaf").alias("leaf"))
    between = graph.edges.join(leaf.select(F.col("id").alias("source"), F.col("leaf").alias("from_scope")), "source").join(leaf.select(F.col("id").alias("target"), F.col("leaf").alias("to_scope")), "target")
    between = between.where("from_scope <> to_scope").select("from_scope", "to_scope", "type").distinct()
    contains = scopes.where(F.contains("scope", F.lit("/"))).select(F.substring_index("scope", "/", 1).alias("from_scope"), F.col("scope").alias("to_scope"), F.lit("contains").alias("type"))
    return modules, contains.union(between)


def view(graph: Graph, name: str, depth: str = "overview", focus_id: str | None = None, query: str | None = None):
    """The view a workbench asks for: `architecture`, `requests`, `data` or `tests`; `focus` goes before the rest."""
    if name == "architecture" and (query or "").strip():
        return graph
    if depth == "focus":
        prefix = "module:workbench/"
        scope = focus_id[len(prefix) :].rpartition(":")[0] if (focus_id or "").startswith(prefix) else None
        return focus(graph, focus_id, scope)
    if name == "requests":
        return request_view(graph)
    if name == "data":
        return data_view(graph)
    if name == "tests":
        return test_graph(graph, focus_id)
    return module_overview(graph) if name == "architecture" and depth == "overview" else graph
