"""Rule queries that find defects. Each gives rows of schema.ISSUE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_auth, is_public_route, severity_rank
from ..graph import Graph
from ..schema import EDGE_TYPES, ISSUE, SEVERITIES
from .lookup import field, ranked_first
from .traverse import strong_components


def _issues(df: DataFrame, kind: str, severity: str, text: Column, id_: Column, key: str | None = None, nodes=None, edges=None, params=None, source: str = "consistency") -> DataFrame:
    """Issue rows; df has file and line of the place."""
    strings = F.array().cast("array<string>")
    return df.select(
        id_.alias("id"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), text.alias("description"), F.lit(key or kind).alias("message_key"),
        (params if params is not None else F.create_map().cast("map<string,string>")).alias("message_params"),
        F.array(F.struct(F.col("file").cast("string").alias("file"), F.col("line").cast("int").alias("line"), F.lit(None).cast("string").alias("note"))).alias("locations"),
        (nodes if nodes is not None else strings).alias("related_nodes"), (edges if edges is not None else strings).alias("related_edges"), F.lit(source).alias("source"),
    )


def _at(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("file", F.col("file_path"))


def _without(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    return nodes.join(edges.select(F.col(end).alias("id")).distinct(), "id", "left_anti")


def dead_calls(graph: Graph) -> DataFrame:
    """Calls to a node that isn't there."""
    ids = graph.nodes.select(F.col("id").alias("target")).distinct()
    lost = graph.edges.where("type = 'calls_api'").join(ids, "target", "left_anti")
    lost = lost.withColumn("file", F.get(F.split("source", ":", 3), F.lit(1))).withColumn("line", F.get_json_object("metadata", "$.callLine").cast("int"))
    return _issues(lost, "dead_api_call", "warning", F.concat(F.lit("Calls "), "target", F.lit(", which does not exist")), F.concat_ws("-", F.lit("dead-api"), "id"), nodes=F.array("source"), edges=F.array("id"))


def unused_routes(graph: Graph) -> DataFrame:
    """Routes and procedures without any edge to them; router containers aside."""
    container = F.coalesce(F.get_json_object("metadata", "$.isRouter") == "true", F.lit(False))
    routes = graph.nodes.where(F.col("type").isin("api_route", "trpc_procedure")).where(~container)
    return _issues(_at(_without(routes, graph.edges, "target")), "unused_route", "info", F.concat(F.lit("Nothing uses "), "name"), F.concat_ws("-", F.lit("unused-route"), "id"), nodes=F.array("id"))


def orphans(graph: Graph) -> DataFrame:
    """Nodes without any edge; modules aside."""
    lone = _without(_without(graph.nodes.where("type <> 'module'"), graph.edges, "target"), graph.edges, "source")
    return _issues(_at(lone), "unused_route", "info", F.concat("name", F.lit(" stands alone")), F.concat_ws("-", F.lit("orphan"), "id"), key="orphan_node", nodes=F.array("id"))


def method_mismatches(graph: Graph) -> DataFrame:
    """Calls with a method that the route's list hasn't; a list with ALL takes any."""
    has, wants = field(graph.nodes, "method"), field(graph.edges, "method")
    routes = graph.nodes.where((F.col("type") == "api_route") & (has != "")).select(F.col("id").alias("target"), F.upper(has).alias("has"))
    calls = graph.edges.where((F.col("type") == "calls_api") & (wants != "")).withColumn("wants", F.upper(wants))
    list_ = F.transform(F.split("has", ","), lambda m: F.trim(m))
    bad = calls.join(routes, "target").where(~F.array_contains(list_, F.col("wants")) & ~F.array_contains(list_, "ALL"))
    bad = bad.withColumn("file", F.get(F.split("source", ":", 3), F.lit(1))).withColumn("line", F.get_json_object("metadata", "$.callLine").cast("int"))
    text = F.concat(F.lit("Calls with "), "wants", F.lit(" where only "), "has", F.lit(" is served"))
    params = F.create_map(F.lit("called"), F.col("wants"), F.lit("served"), F.col("has"))
    return _issues(bad, "method_mismatch", "warning", text, F.concat_ws("-", F.lit("method"), "id"), nodes=F.array("source", "target"), edges=F.array("id"), params=params)


def missing_procedures(graph: Graph) -> DataFrame:
    """tRPC calls whose target isn't there and whose procedure no node has by name or after the router."""
    ids = graph.nodes.select(F.col("id").alias("target")).distinct()
    calls = graph.edges.where("type = 'calls_api'").where(F.get_json_object("metadata", "$.callType") == "trpc").join(ids, "target", "left_anti")
    calls = calls.withColumn("url", F.get_json_object("metadata", "$.url")).where("url is not null")
    procedures = graph.nodes.where("type = 'trpc_procedure'")
    names = procedures.select(F.explode(F.array_compact(F.array("name", F.get_json_object("metadata", "$.procedureName")))).alias("known")).distinct()
    bad = calls.join(names.withColumnRenamed("known", "url"), "url", "left_anti").withColumn("part", F.get(F.split("url", r"\."), F.lit(1)))
    bad = bad.join(names.withColumnRenamed("known", "part"), "part", "left_anti")
    bad = bad.withColumn("file", F.get(F.split("source", ":", 3), F.lit(1))).withColumn("line", F.get_json_object("metadata", "$.callLine").cast("int"))
    return _issues(bad, "missing_procedure", "warning", F.concat(F.lit("Procedure "), "url", F.lit(" does not exist")), F.concat_ws("-", F.lit("procedure"), "id"), nodes=F.array("source"), edges=F.array("id"))


def _dead(graph: Graph, types: tuple[str, ...], edge: str, kind: str, severity: str) -> DataFrame:
    rest = _without(graph.nodes.where(F.col("type").isin(*types)), graph.edges.where(F.col("type") == edge), "target")
    return _issues(_at(rest), kind, severity, F.concat(F.lit("Nothing reaches "), "name"), F.concat_ws("-", F.lit(kind.replace("_", "-")), "id"), nodes=F.array("id"))


def dead_routes(graph: Graph) -> DataFrame:
    return _dead(graph, ("api_route", "trpc_procedure", "express_route"), "calls_api", "dead_route", "warning")


def dead_components(graph: Graph) -> DataFrame:
    return _dead(graph, ("component",), "renders", "dead_component", "info")


def dead_services(graph: Graph) -> DataFrame:
    return _dead(graph, ("service",), "calls_service", "dead_service", "info")


def import_cycles(graph: Graph) -> DataFrame:
    """Strongly connected sets of imports."""
    sets = strong_components(graph.edges.where("type = 'imports'")).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    at = sets.withColumn("file", F.get(F.split("component", ":", 3), F.lit(1))).withColumn("line", F.lit(1))
    return _issues(at, "circular_dependency", "warning", F.concat(F.lit("Import each other: "), F.array_join("ids", ", ")), F.concat(F.lit("circular-"), F.array_join("ids", "-")), nodes=F.col("ids"))


def edge_masks(edges: DataFrame) -> DataFrame:
    """(id, into, out): of every id at an end of an edge, the types of edges into it and out of it as bits of EDGE_TYPES. One
    aggregation, which combines before the shuffle; the edges are read once."""
    bit = F.lit(0).cast("long")
    for i, kind in enumerate(EDGE_TYPES):
        bit = F.when(F.col("type") == kind, F.lit(1 << i).cast("long")).otherwise(bit)
    bits, none = edges.select("source", "target", bit.alias("bit")), F.lit(0).cast("long")
    both = F.array(F.struct(F.col("source").alias("id"), none.alias("into"), F.col("bit").alias("out")), F.struct(F.col("target").alias("id"), F.col("bit").alias("into"), none.alias("out")))
    return bits.select(F.explode(both).alias("end")).select("end.*").groupBy("id").agg(F.bit_or("into").alias("into"), F.bit_or("out").alias("out"))


def _has(mask: str, kind: str) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << EDGE_TYPES.index(kind)).cast("long")) != 0


def _explode_issues(df: DataFrame, issues: list[Column]) -> DataFrame:
    """Each row's issues that are there; the struct's fields become the columns."""
    return df.select(F.explode(F.array_compact(F.array(*issues))).alias("_issue")).select("_issue.*")


def _issue(when: Column, kind: str, severity: str, text: Column, id_: Column, key: str | None, file: Column, line: Column, nodes: Column, edges: Column, params: Column) -> Column:
    place = F.struct(file.cast("string").alias("file"), line.cast("int").alias("line"), F.lit(None).cast("string").alias("note"))
    return F.when(when, F.struct(
        id_.alias("id"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), text.alias("description"), F.lit(key or kind).alias("message_key"), params.alias("message_params"),
        F.array(place).alias("locations"), nodes.alias("related_nodes"), edges.alias("related_edges"), F.lit("consistency").alias("source"),
    ))


def node_issues(graph: Graph) -> DataFrame:
    """Unused routes, lone nodes, dead routes, components and services: all from one aggregation of the edges' types by node,
    joined to the nodes once. Rows as from the rules one by one."""
    seen = graph.nodes.select("id", "type", "name", "file_path", "line", "metadata").join(edge_masks(graph.edges), "id", "left").na.fill(0, ["into", "out"])
    none, no_params = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    container = F.coalesce(F.get_json_object("metadata", "$.isRouter") == "true", F.lit(False))
    make = lambda when, kind, severity, text, prefix, key=None: _issue(when, kind, severity, text, F.concat_ws("-", F.lit(prefix), "id"), key, F.col("file_path"), F.col("line"), F.array("id"), none, no_params)
    dead = lambda types, edge, kind, severity: make(F.col("type").isin(*types) & ~_has("into", edge), kind, severity, F.concat(F.lit("Nothing reaches "), "name"), kind.replace("_", "-"))
    return _explode_issues(seen, [
        make(F.col("type").isin("api_route", "trpc_procedure") & ~container & (F.col("into") == 0), "unused_route", "info", F.concat(F.lit("Nothing uses "), "name"), "unused-route"),
        make((F.col("type") != "module") & (F.col("into") == 0) & (F.col("out") == 0), "unused_route", "info", F.concat("name", F.lit(" stands alone")), "orphan", "orphan_node"),
        dead(("api_route", "trpc_procedure", "express_route"), "calls_api", "dead_route", "warning"), dead(("component",), "renders", "dead_component", "info"),
        dead(("service",), "calls_service", "dead_service", "info"),
    ])


def call_issues(graph: Graph) -> DataFrame:
    """Dead calls and calls with a method that isn't served, from one join of the calls to the nodes. Of nodes that repeat an
    id, an API route is the one that counts."""
    served = F.when(F.col("type") == "api_route", F.nullif(F.upper(F.get_json_object("metadata", "$.method")), F.lit("")))
    nodes = graph.nodes.select(F.col("id").alias("target"), served.alias("has")).groupBy("target").agg(F.max("has").alias("has"), F.lit(True).alias("there"))
    calls = graph.edges.where("type = 'calls_api'").select("id", "source", "target", F.upper(F.get_json_object("metadata", "$.method")).alias("wants"), F.get_json_object("metadata", "$.callLine").cast("int").alias("line"))
    met = calls.join(nodes, "target", "left")
    list_, file = F.transform(F.split("has", ","), lambda m: F.trim(m)), F.get(F.split("source", ":", 3), F.lit(1))
    wrong = F.col("there").isNotNull() & (F.col("wants") != "") & F.col("has").isNotNull() & ~F.array_contains(list_, F.col("wants")) & ~F.array_contains(list_, "ALL")
    none = F.create_map().cast("map<string,string>")
    make = lambda when, kind, text, prefix, ends, params: _issue(when, kind, "warning", text, F.concat_ws("-", F.lit(prefix), "id"), None, file, F.col("line"), ends, F.array("id"), params)
    return _explode_issues(met, [
        make(F.col("there").isNull(), "dead_api_call", F.concat(F.lit("Calls "), "target", F.lit(", which does not exist")), "dead-api", F.array("source"), none),
        make(wrong, "method_mismatch", F.concat(F.lit("Calls with "), "wants", F.lit(" where only "), "has", F.lit(" is served")), "method", F.array("source", "target"), F.create_map(F.lit("called"), F.col("wants"), F.lit("served"), F.col("has"))),
    ])


def consistency(graph: Graph, edge_types: set[str] | None = None) -> DataFrame:
    """All rules on the graph alone: nodes are read twice, edges twice, whatever the number of rules. Calls to nothing can only
    be found on a graph that isn't sanitized. Rules on types of edges that edge_types, if given, leaves out have no input."""
    out = node_issues(graph)
    if edge_types is None or "calls_api" in edge_types:
        out = out.unionByName(call_issues(graph)).unionByName(missing_procedures(graph))
    return out.unionByName(import_cycles(graph)) if edge_types is None or "imports" in edge_types else out


def unguarded_routes(graph: Graph, scopes: DataFrame) -> DataFrame:
    """Handlers (api routes where a file has no handler) whose text calls no guard; public routes aside.

    scopes: node_id, text (the handler's own function, or the route's file)."""
    both = graph.nodes.where(F.col("type").isin("api_route", "handler")).where(F.col("file_path").rlike(r"\.[tj]sx?\z"))
    handled = both.where("type = 'handler'").select("file_path").distinct().withColumn("handled", F.lit(True))
    candidates = both.join(handled, "file_path", "left").where("type = 'handler' or handled is null")
    routes = both.select(F.col("id").alias("route_id"), F.col("file_path").alias("route_file"), F.get_json_object("metadata", "$.route").alias("linked"))
    candidates = candidates.withColumn("route_id", F.get_json_object("metadata", "$.routeId")).join(routes, "route_id", "left")
    route = F.coalesce(F.when(F.col("route_file") == F.col("file_path"), F.col("linked")), F.get_json_object("metadata", "$.route"))
    open_ = candidates.withColumn("route", route).where(~F.coalesce(is_public_route("route"), F.lit(False)))
    open_ = open_.join(scopes.select(F.col("node_id").alias("id"), "text"), "id").where(~has_auth("text"))
    return _issues(_at(open_), "unguarded_route", "critical", F.concat(F.coalesce("route", "name"), F.lit(" checks no permission")), F.concat_ws("-", F.lit("unguarded"), "id"), nodes=F.array("id"), source="auth")


def boundary_violations(graph: Graph, imports: DataFrame, directives: DataFrame) -> DataFrame:
    """Files without `use client` that import one with it by a relative path; one issue for each node and import.

    imports: file, imported (candidate path), specifier, line; directives: file, directive."""
    client = directives.where("directive = 'client'").select(F.col("file").alias("imported"))
    servers = imports.join(directives.where("directive = 'client'").select("file"), "file", "left_anti").join(client, "imported", "left_semi")
    hit = servers.join(graph.nodes.where(F.col("type").isin("page", "component")).select(F.col("file_path").alias("file"), F.col("id").alias("node_id")), "file")
    text = F.concat(F.lit("A server file imports the client file "), "imported")
    return _issues(hit, "rsc_boundary_violation", "warning", text, F.concat_ws("-", F.lit("rsc"), "node_id", "specifier"), nodes=F.array("node_id"), source="rsc")


def repeated_queries(graph: Graph, loops: DataFrame) -> DataFrame:
    """Queries awaited in loops, on the first handler or service of their file. loops: file, line, call."""
    owners = ranked_first(graph.nodes.where(F.col("type").isin("handler", "service")), ["file_path"], "ord").select(F.col("file_path").alias("file"), F.col("id").alias("node_id"))
    hit = loops.join(owners, "file")
    text = F.concat(F.lit("Queries in a loop: "), "call")
    return _issues(hit, "n_plus_one_query", "critical", text, F.concat_ws("-", F.lit("n-plus-one"), "file", F.col("line").cast("string")), nodes=F.array("node_id"), source="n_plus_one")


Detector = Callable[[Graph], DataFrame]


def run_detectors(graph: Graph, detectors: dict[str, Detector]) -> tuple[DataFrame, dict[str, str]]:
    """(issues, failed): every detector by itself. A plan that fails does so when it runs, so each is run here."""
    from ..runtime import cut

    out, failed = graph.spark.createDataFrame([], ISSUE), {}
    for name, detector in detectors.items():
        try:
            out = out.unionByName(cut(detector(graph)))
        except Exception as e:  # one detector's defect must not hide the others' findings
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"
    return out, failed


def dedup_issues(issues: DataFrame, keep: str = "last") -> DataFrame:
    """One issue for each id: the last or the first in the detectors' order (source, then the whole row)."""
    order = F.struct(F.element_at(F.create_map(*[x for i, s in enumerate(("consistency", "auth", "n_plus_one", "rsc")) for x in (F.lit(s), F.lit(i))]), F.col("source")), F.col("description"))
    pick = F.max_by if keep == "last" else F.min_by
    return issues.groupBy(F.col("id").alias("_id")).agg(pick(F.struct(*issues.columns), order).alias("_row")).select("_row.*")


def ranked_issues(issues: DataFrame) -> DataFrame:
    """By severity, file, line and id, in the order of the Unicode collation."""
    first = F.get("locations", F.lit(0))
    return issues.orderBy(severity_rank("severity"), F.collate(first["file"], "UNICODE"), first["line"], F.collate(F.col("id"), "UNICODE"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row: total and the count of each severity."""
    return issues.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def findings(parse_errors: DataFrame, issues: DataFrame) -> DataFrame:
    """Parse errors and issues as one list with a rank: critical, error, warning, info."""
    first = F.get("locations", F.lit(0))
    a = parse_errors.select("severity", F.lit("parser").alias("source"), "file", F.lit(None).cast("int").alias("line"), F.col("message").alias("text"))
    b = issues.select("severity", "source", first["file"].alias("file"), first["line"].alias("line"), F.col("description").alias("text"))
    return a.unionByName(b).withColumn("rank", severity_rank("severity"))


def findings_by(finding: DataFrame) -> DataFrame:
    return finding.groupBy("severity", "source").agg(F.count("*").alias("n"))
