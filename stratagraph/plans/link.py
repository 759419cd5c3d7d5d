"""Linking across layers. Sub-stages go in order, since handlers must exist before services can hang on them."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import match
from ..operators.asof import nearest
from ..operators.dedup import keep_first, merge_coverage
from ..operators.joins import component_uses, kotlin_links, literal_links, page_components, repaired_sources
from ..operators.lookup import ranked_first, route_of
from ..operators.traverse import reach
from ..runtime import cut, importable
from ..schema import EDGE, NODE
from .exports import resolve_imports

_ROUTES = ("api_route", "trpc_procedure", "tsrpc_service", "tsrpc_api", "tsrpc_msg", "express_route", "kotlin_route")


def _j(field: str, column: str = "metadata"):
    return F.get_json_object(column, f"$.{field}")


def _ord(stage: int, *by: str):
    return F.struct(F.lit(stage).cast("long").alias("stage"), F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("parser"), F.xxhash64(*by).alias("emit"))


def as_edges(pairs: DataFrame, kind: str, certain: bool, stage: int, metadata=None) -> DataFrame:
    """Edge rows from (source, target)."""
    out = pairs.withColumn("metadata", metadata if metadata is not None else F.lit("{}"))
    return out.select(
        F.concat_ws("--", "source", F.lit(kind), "target").alias("id"), "source", "target", F.lit(kind).alias("type"), F.lit("certain" if certain else "inferred").alias("confidence"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"), _ord(stage, "source", "target").alias("ord"),
    )


def link_components(graph: Graph) -> Graph:
    """Pages to the page components of their files, and renders of unknown tags to components by name."""
    named = graph.edges.where("type = 'renders'").where(F.get(F.split("target", ":", 3), F.lit(1)) == "unknown")
    uses = named.select("source", F.get(F.split("source", ":", 3), F.lit(1)).alias("file_path"), F.get(F.split("target", ":", 3), F.lit(2)).alias("tag"), "confidence", "metadata")
    # The extractor marks a tag as certain where its file imports it; others stand for no component.
    imports = uses.where("confidence = 'certain'").select("file_path", "tag")
    found = component_uses(uses.select("source", "file_path", "tag").distinct(), imports, graph)
    resolved = found.join(uses, ["source", "tag"]).groupBy("source", "target").agg(F.max((F.col("confidence") == "certain").cast("int")).alias("c"), F.min("metadata").alias("metadata"))
    edges = as_edges(page_components(graph), "renders", True, 1)
    for certain in (True, False):
        edges = edges.unionByName(as_edges(resolved.where(F.col("c") == int(certain)), "renders", certain, 1, F.col("metadata")))
    rest = graph.edges.join(named.select("id"), "id", "left_anti").select(*graph.edges.columns)
    return Graph(graph.nodes, keep_first(rest.unionByName(edges), "id").select(*graph.edges.columns))


def resolve_calls(graph: Graph) -> DataFrame:
    """`calls_api` edges to real routes for those to placeholders; a source that is no node becomes its file's component."""
    ids = graph.nodes.select("id").distinct()
    lost = graph.edges.where("type = 'calls_api'").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    fixed = repaired_sources(graph).select(F.col("edge_id").alias("id"), F.col("source").alias("fixed"))
    calls = lost.join(fixed, "id", "left").withColumn("source", F.coalesce("fixed", "source")).withColumn("kind", _j("callType")).withColumn("url", F.coalesce(_j("url"), F.get(F.split("target", ":", 3), F.lit(2))))
    calls = cut(calls.select("source", "kind", "url", "metadata", "target"))
    routes = graph.nodes.where(F.col("type").isin(*_ROUTES))
    plain = match.match_urls(calls.where("kind in ('fetch', 'axios')"), routes.where(route_of().isNotNull()).select(route_of().alias("route"), F.col("id").alias("target"), "ord"))
    procedures = routes.select(F.col("name").alias("node_name"), F.when(F.col("type") == "trpc_procedure", _j("routerName")).alias("router"), F.when(F.col("type") == "trpc_procedure", _j("procedureName")).alias("procedure"), F.col("id").alias("target"), "ord")
    remote = match.match_procedures(calls.where("kind = 'trpc'").select(F.col("url").alias("name")), procedures)
    services = routes.where("type like 'tsrpc%'").select(F.coalesce(_j("apiPath"), _j("servicePath"), _j("msgName")).alias("path"), F.col("name").alias("node_name"), F.col("id").alias("target"), "ord")
    rpc = match.match_services(calls.where("kind = 'tsrpc'").select(F.col("url").alias("path")), services)
    out = None
    for kinds, found, key, certain in ((("fetch", "axios"), plain, "url", False), (("trpc",), remote, "name", True), (("tsrpc",), rpc, "path", True)):
        hit = calls.where(F.col("kind").isin(*kinds)).join(found.select(F.col(key).alias("url"), F.col("target").alias("resolved")), "url")
        merged = F.to_json(F.map_concat(F.from_json("metadata", "map<string,string>"), F.create_map(F.lit("matchedFrom"), F.col("target"))))
        rows = as_edges(hit.select("source", F.col("resolved").alias("target"), merged.alias("m")), "calls_api", certain, 2, F.col("m"))
        out = rows if out is None else out.unionByName(rows)
    return out


def link_handlers(graph: Graph) -> Graph:
    """A handler for each method of each route: an existing one of the file and method, else a made one; with `handles`."""
    routes = graph.nodes.where(F.col("type").isin("api_route", "trpc_procedure", "tsrpc_api", "express_route"))
    container = F.coalesce(_j("isRouter") == "true", F.lit(False))
    method = F.when(F.col("type") == "trpc_procedure", F.coalesce(_j("procedureName"), F.col("name"))).when(F.col("type") == "tsrpc_api", F.concat(F.lit("Api"), "name")).otherwise(F.coalesce(_j("method"), F.lit("GET")))
    each = routes.where(~container).select("id", "file_path", "line", F.explode(F.split(method, ",")).alias("method")).withColumn("method", F.trim("method")).where("method <> ''")
    each = each.withColumn("handler", F.concat_ws(":", F.lit("handler"), "file_path", "method"))
    known = graph.nodes.where("type = 'handler'").select(F.col("id").alias("handler"))
    made = each.join(known, "handler", "left_anti")
    made = ranked_first(made.withColumn("ord", _ord(3, "id", "method")), ["handler"], "id").select(
        F.col("handler").alias("id"), F.lit("handler").alias("type"), F.col("method").alias("name"), "file_path", "line", F.lit(1).alias("column"),
        F.to_json(F.struct(F.col("method").alias("functionName"), F.lit(True).alias("isSynthetic"), F.col("id").alias("routeId"))).alias("metadata"), "ord",
    )
    edges = as_edges(each.select(F.col("id").alias("source"), F.col("handler").alias("target")).distinct(), "handles", True, 3)
    return Graph(graph.nodes.unionByName(made), graph.edges.unionByName(edges))


def nearest_scopes(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(node_id, text): of nodes (node_id, file_path, line, wanted) the scope (file_path, function, at, text) of the function
    they name, else any of their file; of several the one that starts nearest to the line, ties to the first.

    Lines meet scopes by as-of joins, and texts come last, so no node is joined to all scopes of its file."""
    scopes = scopes.groupBy("file_path", "function", F.col("at").cast("long").alias("line")).agg(F.min("text").alias("text"))
    nodes = nodes.withColumn("line", F.coalesce(F.col("line").cast("long"), F.lit(0)))
    own = nodes.withColumn("function", F.col("wanted"))
    named = cut(own.join(nearest(own, scopes, ["file_path", "function"], "line"), ["file_path", "function", "line"]).select("node_id", "file_path", "function", "nearest"))
    others = nodes.join(named.select("node_id"), "node_id", "left_anti")
    first = scopes.groupBy("file_path", "line").agg(F.min("function").alias("function"))
    anywhere = others.join(nearest(others, first, ["file_path"], "line"), ["file_path", "line"]).join(first.withColumnRenamed("line", "nearest"), ["file_path", "nearest"])
    found = named.unionByName(anywhere.select("node_id", "file_path", "function", "nearest"))
    return found.join(scopes.withColumnRenamed("line", "nearest"), ["file_path", "function", "nearest"]).select("node_id", "text")


def _handler_scopes(graph: Graph, facts: DataFrame) -> DataFrame:
    """(node_id, type, file_path, text): the handler's own function by name or nearest line, else by the whole file's scopes."""
    scopes = facts.where("kind = 'scope'").select(F.col("path").alias("file_path"), F.col("name").alias("function"), F.col("line").alias("at"), F.col("value").alias("text"))
    nodes = graph.nodes.where(F.col("type").isin("handler", "service")).select(F.col("id").alias("node_id"), "type", "file_path", "line", F.coalesce(_j("functionName"), _j("methodName"), F.col("name")).alias("wanted"))
    nodes = cut(nodes)  # read several times below, and dear to derive where links made them
    return nodes.select("node_id", "type", "file_path").join(nearest_scopes(nodes.drop("type"), scopes), "node_id")


def link_services(graph: Graph, facts: DataFrame) -> Graph:
    """Calls of imported functions within a handler's own scope: to a service of that name, else to one made here."""
    imports = facts.where("kind = 'import' and name <> ''").select(F.col("path").alias("file_path"), F.col("name").alias("local"), F.col("source").alias("specifier"), F.col("target").alias("imported")).where("specifier like '.%' or specifier like '@/%'")
    scopes = _handler_scopes(graph, facts).where("type = 'handler'")
    calls = scopes.select("node_id", "file_path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w.$])([A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)?\s*\("), F.lit(1)))).alias("local"))
    used = calls.join(imports, ["file_path", "local"])
    services = graph.nodes.where("type = 'service'").select(F.col("name").alias("key"), F.col("id").alias("known"), "ord")
    services = services.unionByName(graph.nodes.where("type = 'service'").select(_j("methodName").alias("key"), F.col("id").alias("known"), "ord"))
    first = services.where("key is not null").groupBy("key").agg(F.min_by("known", "ord").alias("known"))
    used = used.withColumn("key", F.when(F.col("imported").isin("default", "*"), F.col("local")).otherwise(F.col("imported"))).join(first, "key", "left")
    used = used.withColumn("target", F.coalesce("known", F.concat_ws(":", F.lit("service"), "file_path", "key")))
    made = ranked_first(used.where("known is null").withColumn("ord", _ord(4, "target")), ["target"], "node_id").select(
        F.col("target").alias("id"), F.lit("service").alias("type"), F.col("key").alias("name"), "file_path", F.lit(0).alias("line"), F.lit(0).alias("column"),
        F.to_json(F.struct(F.col("specifier").alias("importedFrom"), F.lit(True).alias("isSynthetic"), F.col("key").alias("methodName"))).alias("metadata"), "ord",
    )
    edges = as_edges(used.select(F.col("node_id").alias("source"), "target").distinct(), "calls_service", False, 4)
    return Graph(graph.nodes.unionByName(made), graph.edges.unionByName(edges))


def link_queries(graph: Graph, facts: DataFrame) -> Graph:
    """Queries in a caller's scope to models of that name, whatever the case; of models with one name the last counts. Of a
    pair's different operations, in the order they first appear, the last is the edge's; all are listed beside it."""
    scopes = _handler_scopes(graph, facts)
    pattern = r"(?:prisma|db|tx)\.(\w+)\.(\w+)\s*\(|(?<![\w.])(?:this\.)?(\w+?)[rR]epo(?:sitory)?\.(\w+)\s*\(|[mM]anager\.(\w+)\s*\(\s*(\w+)"
    hits = scopes.select("node_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "hit"))
    part = lambda i: F.nullif(F.regexp_extract("hit", pattern, i), F.lit(""))
    calls = hits.select("node_id", "at", F.lower(F.coalesce(part(1), part(3), part(6))).alias("key"), F.coalesce(part(2), part(4), part(5)).alias("operation")).where("key is not null")
    models = graph.nodes.where("type = 'db_model'").groupBy(F.lower("name").alias("key")).agg(F.max_by("id", "ord").alias("target"))
    return Graph(graph.nodes, graph.edges.unionByName(as_edges(query_operations(calls.join(models, "key")), "queries_db", False, 5, F.to_json(F.struct("operation", "operations")))))


def query_operations(calls: DataFrame) -> DataFrame:
    """(source, target, operation, operations) of calls (node_id, target, at, operation): the operations of each pair in the
    order they first appear, and the last of them."""
    once = calls.groupBy(F.col("node_id").alias("source"), "target", "operation").agg(F.min("at").alias("at"))
    listed = once.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("at", "operation"))).alias("_l"))
    return listed.select("source", "target", F.element_at("_l", -1)["operation"].alias("operation"), F.transform("_l", lambda x: x["operation"]).alias("operations"))


def import_edges(facts: DataFrame, aliases: match.PathAliases | None = None) -> DataFrame:
    """(file, imported, specifier, line): relative and aliased imports against the paths they may mean."""
    importable(facts.sparkSession)
    aliases = aliases or match.PathAliases({})
    rel = facts.where("kind = 'import'").where(F.col("source").startswith(".") | F.lit(aliases.any)).select(F.col("path").alias("file"), F.col("source").alias("specifier"), "line").distinct()

    @F.pandas_udf("array<string>")
    def candidates(file: pd.Series, specifier: pd.Series) -> pd.Series:
        return pd.Series([aliases.files(s, f) for f, s in zip(file, specifier)])

    return rel.select("file", "specifier", "line", F.explode(candidates("file", "specifier")).alias("imported"))


def call_edges(facts: DataFrame, aliases: match.PathAliases | None = None, exports: DataFrame | None = None) -> DataFrame:
    """(source, target): a function "file#name" to those it calls by name, its file's own or imported ones, if they exist.

    With exports (as from `exports.export_facts`) a name leads to the file that defines it, through files that pass it on."""
    scopes = facts.where("kind = 'scope'").select(F.col("path").alias("file"), "name", F.col("value").alias("text"))
    known = scopes.select(F.concat_ws("#", "file", "name").alias("target")).distinct()
    called = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\("), F.lit(1))))
    calls = scopes.select("file", F.concat_ws("#", "file", "name").alias("source"), called.alias("local"))
    names = facts.where("kind = 'import' and name <> ''").select(F.col("path").alias("file"), F.col("name").alias("local"), F.col("source").alias("specifier"), F.col("target").alias("wanted"))
    names = names.withColumn("wanted", F.when(F.col("wanted").isin("default", "*"), F.col("local")).otherwise(F.col("wanted")))
    abroad = calls.join(names, ["file", "local"]).join(import_edges(facts, aliases).select("file", "specifier", "imported").distinct(), ["file", "specifier"])
    if exports is not None:
        specifiers = exports.where("specifier is not null").select(F.lit("import").alias("kind"), F.col("file").alias("path"), F.col("specifier").alias("source"), F.lit(1).alias("line"))
        paths = import_edges(facts.select("kind", "path", "source", "line").unionByName(specifiers), aliases).select("file", "specifier", "imported").distinct()
        given = resolve_imports(abroad.select("imported", "wanted").distinct(), facts, exports, paths)
        abroad = abroad.join(given, ["imported", "wanted"]).select("source", F.col("def_file").alias("imported"), F.col("def_name").alias("wanted"))
    found = abroad.select("source", F.concat_ws("#", "imported", "wanted").alias("target")).union(calls.select("source", F.concat_ws("#", "file", "local")))
    return found.join(known, "target", "left_semi").select("source", "target").where("source <> target").distinct()


def call_chains(facts: DataFrame, starts: DataFrame, depth: int = 5, aliases: match.PathAliases | None = None, exports: DataFrame | None = None) -> DataFrame:
    """Functions "file#name" that those in `starts` (id) reach over at most `depth` calls. Calls are matched by name and
    import; methods of objects and types are not resolved."""
    return reach(call_edges(facts, aliases, exports), starts, depth)


def link_tests(graph: Graph, facts: DataFrame, files: DataFrame, aliases: match.PathAliases | None = None) -> DataFrame:
    """Coverage edges: named imports of a test file that mean exactly one production node, certain if called in the file;
    and route literals in quotes."""
    cases = graph.nodes.where("type = 'test_case'").select(F.col("id").alias("case_id"), "file_path")
    production = graph.nodes.where(~F.col("type").isin("test_suite", "test_case", "test_fixture")).select(F.col("id").alias("target"), F.col("file_path").alias("imported"), F.coalesce(_j("functionName"), F.col("name")).alias("wanted"))
    named = facts.where("kind = 'import' and name <> ''").select(F.col("path").alias("file"), "name", F.col("source").alias("specifier"), F.col("target").alias("what")).withColumn("wanted", F.when(F.col("what").isin("default", "*"), F.col("name")).otherwise(F.col("what")))
    paths = import_edges(facts, aliases).select("file", "specifier", "imported").distinct()
    found = cases.join(named, cases["file_path"] == named["file"]).join(paths, ["file", "specifier"]).join(production, ["imported", "wanted"])
    single = found.groupBy("case_id", "file", "name").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1")
    texts = files.select(F.col("path").alias("file"), "text")
    called = single.join(texts, "file").withColumn("called", F.expr("regexp_like(text, concat(r'(?<![A-Za-z0-9_$.])', name, r'\\s*\\('))"))
    direct = lambda certain: as_edges(called.where(F.col("called") == F.lit(certain)).select(F.col("case_id").alias("source"), "target").distinct(), "covers", certain, 6, F.lit('{"evidence":"direct_import"}'))
    routes = graph.nodes.where(F.col("type").isin(*_ROUTES)).select(route_of().alias("route"), F.col("id").alias("target")).where("route is not null")
    literals = literal_links(texts.join(cases.select(F.col("file_path").alias("file")).distinct(), "file", "left_semi").select(F.col("file").alias("source"), "text"), routes)
    by_route = as_edges(cases.join(literals.withColumnRenamed("source", "file_path"), "file_path").select(F.col("case_id").alias("source"), "target").distinct(), "covers", False, 7, F.lit('{"evidence":"route_literal"}'))
    return merge_coverage(direct(True), direct(False), by_route)


def checked(graph: Graph) -> Graph:
    """The columns of the model, in its order."""
    return Graph(graph.nodes.select(*[f.name for f in NODE]), graph.edges.select(*[f.name for f in EDGE]))


def link(graph: Graph, facts: DataFrame, present: frozenset[str] | None = None) -> Graph:
    """Calls, handlers, services, queries and Kotlin links, in this order.

    present: what there is, as from `shape`; a step whose input isn't there is left out, as it would add nothing."""
    has = lambda *what: present is None or not present.isdisjoint(what)
    routes = has(*(f"node:{t}" for t in ("api_route", "trpc_procedure", "tsrpc_api", "express_route")))
    if has("edge:calls_api"):
        graph = Graph(graph.nodes, graph.edges.unionByName(resolve_calls(graph)))
    if routes:
        graph = link_handlers(graph)
    if has("fact:scope") and (routes or has("node:handler", "node:service")):
        if has("fact:import"):
            graph = link_services(Graph(cut(graph.nodes), cut(graph.edges)), facts)
        if has("node:db_model"):
            graph = link_queries(Graph(cut(graph.nodes), graph.edges), facts)
    if has("node:kotlin_route", "node:kotlin_function", "node:kotlin_class"):
        kotlin = kotlin_links(graph)
        for kind in ("handles", "calls_service", "queries_db"):
            graph = Graph(graph.nodes, graph.edges.unionByName(as_edges(kotlin.where(F.col("type") == kind), kind, False, 8)))
    return checked(graph)


def shape(graph: Graph, facts: DataFrame) -> frozenset[str]:
    """What there is in stage 0: node:TYPE, edge:TYPE and fact:KIND; and case:test where there are test cases. One small job,
    with a row for each type."""
    names = lambda df, what, kind: df.select(F.concat(F.lit(f"{what}:"), kind).alias("name"))
    first = names(graph.nodes.where("ord.stage = 0"), "node", F.col("type")).union(names(graph.edges.where("ord.stage = 0"), "edge", F.col("type")))
    rest = names(facts, "fact", F.col("kind")).union(graph.nodes.where("type = 'test_case'").select(F.lit("case:test")))
    return frozenset(r["name"] for r in first.union(rest).distinct().collect())
