"""The registered graph queries over the derived graph, each with the SQL that a second engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .graph import Graph
from .operators import coverage, dedup, detect, joins, lookup, match, stats, traverse
from .runtime import load
from .schema import LINK_EDGES
from .sources import derived
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_WITH = f"WITH RECURSIVE nodes AS ({derived.text(derived.NODES)}), edges AS ({derived.text(derived.EDGES)})"
_KEPT = "kept AS (SELECT DISTINCT source, target, type FROM edges WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"


def query(sql: str | None = None, graph: bool = True):
    """Registers a query; its SQL stands on the CTEs nodes and edges if it is one on the graph."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            _ORACLES[f.__name__] = (f"{_WITH}, {body[5:]}" if body.upper().startswith("WITH ") else f"{_WITH} {body}") if graph else body
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return derived.graph(spark, sf_dir)


# Lookups and filters


@query("SELECT id, name, file_path FROM nodes WHERE type = 'service'")
def nodes_by_type(spark, sf):
    return lookup.nodes_by_type(_graph(spark, sf), "service").select("id", "name", "file_path")


@query("SELECT id, type FROM nodes WHERE type IN ('service', 'db_model', 'handler')")
def nodes_by_types(spark, sf):
    return lookup.nodes_by_type(_graph(spark, sf), "service", "db_model", "handler").select("id", "type")


@query("SELECT id FROM nodes WHERE file_path = 'backend/src/part/r3.ts'")
def nodes_by_file(spark, sf):
    return lookup.nodes_by_file(_graph(spark, sf), "backend/src/part/r3.ts").select("id")


@query("SELECT id, type, name FROM nodes WHERE id = 'service:nation:NATION_3'")
def node_by_id(spark, sf):
    return lookup.node(_graph(spark, sf), "service:nation:NATION_3").select("id", "type", "name")


@query("SELECT source, target FROM edges WHERE type = 'calls_service'")
def edges_by_type(spark, sf):
    return lookup.edges_by_type(_graph(spark, sf), "calls_service").select("source", "target")


@query("SELECT source, type, target FROM edges WHERE source = 'service:nation:NATION_3'")
def out_edges(spark, sf):
    return lookup.out_edges(_graph(spark, sf), "service:nation:NATION_3").select("source", "type", "target")


@query("SELECT source, type, target FROM edges WHERE target = 'api_route:part:7'")
def in_edges(spark, sf):
    return lookup.in_edges(_graph(spark, sf), "api_route:part:7").select("source", "type", "target")


@query("SELECT id FROM nodes WHERE json_extract_string(metadata, '$.route') = '/api/part/7/' ORDER BY o1, o2 LIMIT 1")
def find_by_route(spark, sf):
    return lookup.find_by_route(_graph(spark, sf), "/api/part/7/").select("id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'", graph=False)
def find_by_json_field(spark, sf):
    return load(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN json_extract_string(metadata, '$.route') = 'NATION_3' THEN 0 WHEN file_path = 'NATION_3' THEN 1 ELSE 2 END, o1, o2) AS k
FROM nodes WHERE json_extract_string(metadata, '$.route') = 'NATION_3' OR file_path = 'NATION_3' OR name = 'NATION_3') WHERE k = 1""")
def find_any_cascade(spark, sf):
    return lookup.find_any(_graph(spark, sf), "NATION_3").select("id")


@query("SELECT id FROM nodes WHERE contains(lower(name), 'nation_1') OR contains(lower(file_path), 'nation_1')")
def search_nodes(spark, sf):
    return lookup.search(_graph(spark, sf), "  Nation_1 ").select("id")


@query("""WITH ids AS (SELECT id FROM nodes WHERE type IN ('handler', 'service'))
SELECT source, type, target FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)""")
def induced_subgraph(spark, sf):
    g = _graph(spark, sf)
    return lookup.induced(g, g.nodes.where("type in ('handler', 'service')").select("id")).edges.select("source", "type", "target")


@query("""SELECT id FROM nodes WHERE type IN ('component', 'handler') AND id IN (SELECT source FROM edges UNION SELECT target FROM edges)""")
def facet_filter_hide_isolated(spark, sf):
    return lookup.facet_filter(_graph(spark, sf), node_types=("component", "handler"), hide_isolated=True).nodes.select("id")


@query("""SELECT source, target FROM edges WHERE type = 'calls_api' AND confidence = 'inferred'
AND source IN (SELECT id FROM nodes WHERE type IN ('component', 'api_route')) AND target IN (SELECT id FROM nodes WHERE type IN ('component', 'api_route'))""")
def facet_filter_edges(spark, sf):
    g = lookup.facet_filter(_graph(spark, sf), ("component", "api_route"), ("calls_api",), ("inferred",))
    return g.edges.select("source", "target")


@query("""SELECT n.id, json_extract_string(n.metadata, '$.method') AS method, json_extract_string(n.metadata, '$.route') AS path, count(DISTINCT e.target) AS n_handlers
FROM nodes n LEFT JOIN edges e ON e.source = n.id AND e.type = 'handles' AND e.target IN (SELECT id FROM nodes)
WHERE n.type = 'api_route' AND (contains(n.name, '1') OR contains(json_extract_string(n.metadata, '$.route'), '1')) GROUP BY 1, 2, 3""")
def api_routes_filtered(spark, sf):
    return lookup.api_routes(_graph(spark, sf), "1").select("id", "method", "path", F.coalesce(F.size("handlers"), F.lit(0)).cast("long").alias("n_handlers"))


@query("SELECT id, name, json_extract_string(metadata, '$.tableName') AS table_name, CAST(json_extract_string(metadata, '$.fieldCount') AS INTEGER) AS field_count FROM nodes WHERE type = 'db_model'")
def db_models(spark, sf):
    return lookup.db_models(_graph(spark, sf)).select("id", "name", "table_name", "field_count")


@query("SELECT id, json_extract_string(metadata, '$.method') AS method, json_extract_string(metadata, '$.route') AS route, false AS next_route FROM nodes WHERE type = 'api_route'")
def typed_metadata(spark, sf):
    return lookup.typed_nodes(_graph(spark, sf), "api_route").select("id", "method", "route", F.col("isNextApiRoute").alias("next_route"))


# Joins


@query("SELECT n.id, n.type FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'api_route:part:7'")
def downstream(spark, sf):
    return joins.downstream(_graph(spark, sf), "api_route:part:7").select("id", "type")


@query("SELECT n.id, n.type FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'api_route:part:7' AND e.type = 'calls_api'")
def upstream(spark, sf):
    return joins.upstream(_graph(spark, sf), "api_route:part:7", ("calls_api",)).select("id", "type")


@query("""SELECT id, CAST(count_if(k = 'i') AS BIGINT) AS in_degree, CAST(count_if(k = 'o') AS BIGINT) AS out_degree FROM
(SELECT id, '-' AS k FROM nodes UNION ALL SELECT target, 'i' FROM edges WHERE target IN (SELECT id FROM nodes) UNION ALL SELECT source, 'o' FROM edges WHERE source IN (SELECT id FROM nodes)) GROUP BY id""")
def degree(spark, sf):
    return joins.degrees(_graph(spark, sf))


@query("""SELECT type, target, count(DISTINCT source) AS n_callers FROM edges GROUP BY 1, 2""")
def callers_by_type(spark, sf):
    return joins.callers_by_type(_graph(spark, sf))


@query("""SELECT CASE WHEN source NOT IN (SELECT id FROM nodes) THEN 'missing_source' WHEN target NOT IN (SELECT id FROM nodes) THEN 'missing_target' ELSE 'ok' END AS verdict, count(*) AS n FROM edges GROUP BY 1""")
def endpoint_validation(spark, sf):
    return dedup.endpoint_report(_graph(spark, sf))


@query("SELECT source, target, type FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)")
def dangling_edges(spark, sf):
    return dedup.dangling(_graph(spark, sf)).select("source", "target", "type")


@query("""SELECT CASE WHEN source NOT IN (SELECT id FROM nodes) THEN 'missing_source' ELSE 'missing_target' END AS reason, count(*) AS n
FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes) GROUP BY 1""")
def rejected_edges(spark, sf):
    return dedup.rejected_edges(_graph(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT a.id AS source, b.id AS target FROM (SELECT id, type, CASE WHEN type = 'handler' THEN 'backend/src/supplier/h' || CAST(o2 % 5 AS VARCHAR) || '.ts' ELSE file_path END AS file_path FROM nodes) a
JOIN (SELECT id, type, CASE WHEN type = 'handler' THEN 'backend/src/supplier/h' || CAST(o2 % 5 AS VARCHAR) || '.ts' ELSE file_path END AS file_path FROM nodes) b ON a.file_path = b.file_path WHERE a.type = 'handler' AND b.type = 'handler' AND a.id <> b.id""")
def same_file_link(spark, sf):
    """Handlers in five large files, whose pairs are as many as a fifth of the square of all handlers."""
    graph = _graph(spark, sf)
    path = F.when(F.col("type") == "handler", F.concat(F.lit("backend/src/supplier/h"), (F.col("ord.file") % 5).cast("string"), F.lit(".ts"))).otherwise(F.col("file_path"))
    return joins.same_file_links(Graph(graph.nodes.withColumn("file_path", path), graph.edges), "handler", "handler", spread=64)


@query("""SELECT s_suppkey AS want, min(c_name) AS target FROM supplier JOIN customer ON round(s_acctbal) = round(c_acctbal) GROUP BY s_suppkey HAVING count(DISTINCT c_name) = 1""", graph=False)
def unique_candidate_link(spark, sf):
    wanted = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("want"), F.round("s_acctbal").alias("k"))
    candidates = load(spark, sf, "customer").select(F.round("c_acctbal").alias("k"), F.col("c_name").alias("target"))
    return joins.unique_candidates(wanted, candidates, ["k"], ["want"])


@query("""SELECT DISTINCT p.page_id AS source, r.route AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '["''`]([^"''`\\n]+)["''`]', 1)) AS route FROM pages) p
JOIN (SELECT DISTINCT '/' || lower(split_part(p_type, ' ', 1)) AS route FROM part UNION SELECT '/The' UNION SELECT '/and') r ON p.route = r.route""", graph=False)
def literal_contains_link(spark, sf):
    texts = load(spark, sf, "pages").select(F.col("page_id").alias("source"), F.col("html").alias("text"))
    kinds = load(spark, sf, "part").select(F.concat(F.lit("/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("route"))
    routes = kinds.union(spark.sql("SELECT '/The' UNION ALL SELECT '/and'")).distinct()
    return joins.literal_links(texts, routes.withColumn("target", F.col("route")))


@query("""SELECT 'conv' || CAST(conv_id AS STRING) AS suite, 'none ' || CAST(turn AS STRING) AS name FROM conversations""", graph=False)
def unmatched_cases(spark, sf):
    """Results of every turn, and of as many cases that no file has."""
    c = load(spark, sf, "conversations")
    suite, turn = F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("suite"), F.col("turn").cast("string")
    results = c.select(suite, F.concat(F.lit("turn "), turn).alias("name")).union(c.select(suite, F.concat(F.lit("none "), turn).alias("name")))
    cases = c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(" > turn "), turn).alias("name"))
    return joins.unmatched_cases(results, cases)


# Aggregates and deduplication


@query("""SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type""")
def type_counts(spark, sf):
    return stats.type_counts(_graph(spark, sf))


@query("SELECT count(*) FILTER (type = 'calls_api') AS calls_api, count(*) FILTER (type = 'handles') AS handles, count(*) FILTER (type = 'calls_service') AS calls_service, count(*) FILTER (type = 'queries_db') AS queries_db FROM edges")
def cross_layer_counts(spark, sf):
    return stats.edge_class_counts(_graph(spark, sf))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""", graph=False)
def dedup_first(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey").alias("ord"))
    return dedup.keep_first(rows, "l_orderkey", "l_linenumber").drop("ord")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1""", graph=False)
def dedup_last(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey").alias("ord"))
    return dedup.keep_last(rows, "l_orderkey", "l_linenumber").drop("ord")


@query("""SELECT source || '--' || type || '--' || target AS id, max(confidence = 'certain') AS certain FROM edges WHERE type = 'handles' GROUP BY 1""")
def merge_confidence(spark, sf):
    handles = _graph(spark, sf).edges.where("type = 'handles'")
    merged = dedup.merge_coverage(handles.where("confidence = 'inferred'"), handles.where("confidence = 'certain'"))
    return merged.select("id", (F.col("confidence") == "certain").alias("certain"))


@query("""WITH e AS (SELECT source, target, type, CASE WHEN source = target THEN 'self_loop' WHEN source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes) THEN 'dangling' END AS reason FROM edges),
d AS (SELECT reason, row_number() OVER (PARTITION BY source, type, target, reason ORDER BY source) AS k FROM e)
SELECT count(*) FILTER (reason = 'self_loop') AS self_loop, count(*) FILTER (reason = 'dangling') AS dangling, count(*) FILTER (reason IS NULL AND k > 1) AS duplicate, count(*) FILTER (reason IS NULL AND k = 1) AS kept FROM d""")
def sanitize_stats(spark, sf):
    return dedup.sanitize(_graph(spark, sf)).removed


@query(f"WITH {_KEPT} SELECT source, target, type FROM kept")
def sanitize_edges(spark, sf):
    return dedup.sanitized_edges(_graph(spark, sf)).select("source", "target", "type")


@query(f"""SELECT count(*) FILTER (source = target) AS self_loop, CAST(0 AS BIGINT) AS dangling,
count(*) FILTER (source <> target) - count(DISTINCT CASE WHEN source <> target THEN source || '>' || target END) AS duplicate, count(DISTINCT CASE WHEN source <> target THEN source || '>' || target END) AS kept
FROM ({derived.text(derived.TRANSITIONS)})""", graph=False)
def sanitize_transitions(spark, sf):
    moves = derived.run(spark, sf, derived.TRANSITIONS)
    edges = moves.select(F.concat_ws("--", "source", F.lit("imports"), "target").alias("id"), "source", "target", F.lit("imports").alias("type"), F.struct("o2").alias("ord"))
    ids = moves.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return dedup.sanitize(Graph(ids, edges)).removed


@query("""SELECT o1 AS place, type, n FROM (SELECT type, min(o1) AS o1, count(*) AS n FROM nodes GROUP BY type)""")
def types_in_order(spark, sf):
    return stats.types_in_order(_graph(spark, sf)).select(F.col("first_ord.stage").cast("int").alias("place"), "type", "n")


@query("SELECT file_path, count(*) AS n FROM nodes WHERE type IN ('handler', 'service') GROUP BY 1")
def eligible_callers(spark, sf):
    return stats.per_file(_graph(spark, sf).nodes, "handler", "service")


@query("""SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS digest FROM nation""", graph=False)
def row_digest(spark, sf):
    return load(spark, sf, "nation").select(F.sha2(F.to_json(F.struct("n_nationkey", "n_name")), 256).alias("digest"))


# Detectors


@query("""SELECT source, target FROM edges WHERE type = 'calls_api' AND target NOT IN (SELECT id FROM nodes)
UNION ALL SELECT source, 'api_route:part:-1' FROM edges WHERE type = 'calls_service'""")
def dead_call(spark, sf):
    g = _graph(spark, sf)
    made_up = g.edges.where("type = 'calls_service'").withColumn("target", F.lit("api_route:part:-1")).withColumn("type", F.lit("calls_api"))
    found = detect.dead_calls(Graph(g.nodes, g.edges.unionByName(made_up)))
    return found.select(F.col("related_nodes")[0].alias("source"), F.split_part("description", F.lit(" "), F.lit(2)).alias("target")).withColumn("target", F.rtrim(F.regexp_replace("target", ",$", "")))


_ALL = f"every AS (SELECT * FROM nodes UNION ALL {derived.text(derived.LONE)})"


def _with_lone(spark, sf) -> Graph:
    return derived.graph(spark, sf, lone=True)


@query(f"WITH {_ALL} SELECT id FROM every WHERE type = 'api_route' AND id NOT IN (SELECT target FROM edges)")
def unused_route(spark, sf):
    return detect.unused_routes(_with_lone(spark, sf)).select(F.col("related_nodes")[0].alias("id"))


@query("SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges) UNION ALL SELECT 'service:x:' || r_name FROM region")
def orphan(spark, sf):
    g = _graph(spark, sf)
    lone = g.nodes.where("type = 'db_model'").withColumn("id", F.concat(F.lit("service:x:"), "name")).withColumn("type", F.lit("service"))
    return detect.orphans(Graph(g.nodes.unionByName(lone), g.edges)).select(F.col("related_nodes")[0].alias("id"))


@query("""SELECT e.source, e.target FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type = 'calls_api' AND json_extract_string(e.metadata, '$.method') IS NOT NULL
AND NOT list_contains(string_split(json_extract_string(n.metadata, '$.method'), ','), json_extract_string(e.metadata, '$.method')) AND json_extract_string(n.metadata, '$.method') <> 'ALL'""")
def method_mismatch(spark, sf):
    return detect.method_mismatches(_graph(spark, sf)).select(F.col("related_nodes")[0].alias("source"), F.col("related_nodes")[1].alias("target"))


@query("SELECT DISTINCT c_mktsegment || '.' || c_name AS url FROM customer WHERE c_name NOT IN (SELECT p_brand FROM part) UNION SELECT p_type FROM part WHERE p_type NOT IN (SELECT p_brand FROM part)", graph=False)
def missing_name(spark, sf):
    part = load(spark, sf, "part")
    names = part.select(F.concat(F.lit("trpc_procedure:x:"), "p_brand").alias("id"), F.lit("trpc_procedure").alias("type"), F.col("p_brand").alias("name"), F.lit("x").alias("file_path"), F.lit("{}").alias("metadata"))
    urls = part.select(F.explode(F.array("p_brand", "p_type", F.concat(F.lit("any."), "p_brand"))).alias("url")).union(load(spark, sf, "customer").select(F.concat_ws(".", "c_mktsegment", "c_name")))
    calls = urls.distinct().select(F.lit("calls_api").alias("type"), F.lit("component:a:b").alias("source"), F.concat(F.lit("trpc_procedure:unknown:"), "url").alias("target"), "url")
    calls = calls.select(F.concat_ws("--", "source", "type", "target").alias("id"), "type", "source", "target", F.to_json(F.struct(F.lit("trpc").alias("callType"), F.col("url"))).alias("metadata"))
    found = detect.missing_procedures(Graph(names, calls))
    return found.select(F.regexp_extract("description", "^Procedure (.*) does not exist$", 1).alias("url"))


@query(f"WITH {_ALL} SELECT id FROM every WHERE type = 'api_route' AND id NOT IN (SELECT target FROM edges WHERE type = 'calls_api')")
def dead_route(spark, sf):
    return detect.dead_routes(_with_lone(spark, sf)).select(F.col("related_nodes")[0].alias("id"))


@query(f"WITH {_ALL} SELECT id FROM every WHERE type = 'component' AND id NOT IN (SELECT target FROM edges WHERE type = 'renders')")
def dead_component(spark, sf):
    return detect.dead_components(_with_lone(spark, sf)).select(F.col("related_nodes")[0].alias("id"))


@query(f"WITH {_ALL} SELECT id FROM every WHERE type = 'service' AND id NOT IN (SELECT target FROM edges WHERE type = 'calls_service')")
def dead_service(spark, sf):
    return detect.dead_services(_with_lone(spark, sf)).select(F.col("related_nodes")[0].alias("id"))


_ISSUES = """SELECT 'unused_route' AS type, 'info' AS severity, id FROM every WHERE type = 'api_route' AND id NOT IN (SELECT target FROM edges)
UNION ALL SELECT 'dead_route', 'warning', id FROM every WHERE type = 'api_route' AND id NOT IN (SELECT target FROM edges WHERE type = 'calls_api')
UNION ALL SELECT 'dead_service', 'info', id FROM every WHERE type = 'service' AND id NOT IN (SELECT target FROM edges WHERE type = 'calls_service')"""


def _some_issues(spark, sf) -> DataFrame:
    g = _with_lone(spark, sf)
    return detect.node_issues(g).where("type in ('unused_route', 'dead_route', 'dead_service') and message_key <> 'orphan_node'")


@query(f"WITH {_ALL}, issues AS ({_ISSUES}) SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM issues")
def severity_summary(spark, sf):
    return detect.issue_summary(_some_issues(spark, sf))


@query(f"""WITH {_ALL}, issues AS ({_ISSUES}) SELECT k AS place, severity, id FROM (SELECT severity, id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 2 ELSE 3 END, type, id) AS k FROM issues) WHERE k <= 25""")
def issues_ranked_top(spark, sf):
    issues = _some_issues(spark, sf).select("severity", "type", F.col("related_nodes")[0].alias("id"))
    order = Window.orderBy("rank", "type", "id")
    top = issues.withColumn("rank", C.severity_rank("severity")).orderBy("rank", "type", "id").limit(25)
    return top.withColumn("place", F.row_number().over(order).cast("long")).select("place", "severity", "id")


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY o1, o2) AS k FROM nodes WHERE contains(lower(name), '1') OR contains(lower(file_path), '1')) WHERE k <= 20")
def top20_search(spark, sf):
    return lookup.search(_graph(spark, sf), "1").orderBy("ord").limit(20).select("id")


# Matchers


_CALL_URLS = """SELECT CASE p_partkey % 5 WHEN 0 THEN '/api/part/' || CAST(p_partkey AS STRING) || '?x=1' WHEN 1 THEN '/base/api/part/' || CAST(p_partkey AS STRING)
WHEN 2 THEN 'other/' || CAST(p_partkey AS STRING) || '/' WHEN 3 THEN '/api/x/none' ELSE '/part/' || CAST(p_partkey AS STRING) END AS url FROM {part}"""


@query(f"""WITH calls AS (SELECT DISTINCT url FROM ({derived.text(_CALL_URLS)})),
routes AS (SELECT id, o2, '/api/part/' || CAST(o2 AS STRING) AS u, CAST(o2 AS STRING) AS last FROM nodes WHERE type = 'api_route'),
norm AS (SELECT url, CASE WHEN starts_with(u, '/') THEN u ELSE '/' || u END AS u FROM (SELECT url, regexp_replace(split_part(url, '?', 1), '/$', '') AS u FROM calls)),
hits AS (SELECT url, 0 AS tier, id, o2 FROM norm JOIN routes USING (u)
UNION ALL SELECT url, 1, id, o2 FROM norm JOIN routes ON regexp_replace(norm.u, '^/api', '') = routes.u
UNION ALL SELECT url, 2, id, o2 FROM norm JOIN routes ON regexp_extract(norm.u, '^/[^/]+(/api/.+)$', 1) = routes.u
UNION ALL SELECT url, 3, id, o2 FROM norm JOIN routes ON regexp_extract(norm.u, '([^/]+)$', 1) = routes.last)
SELECT url, CAST(tier AS INTEGER) AS tier, id AS target FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tier, o2) AS k FROM hits) WHERE k = 1""")
def match_url_tiers(spark, sf):
    g = _graph(spark, sf)
    routes = g.nodes.where("type = 'api_route'").select(lookup.route_of().alias("route"), F.col("id").alias("target"), "ord")
    return match.match_urls(derived.run(spark, sf, _CALL_URLS), routes)


@query("""WITH calls AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || '.' || p_type END AS name FROM part UNION SELECT c_name FROM customer),
hits AS (SELECT c.name, 0 AS tier, p.p_partkey AS k FROM calls c JOIN part p ON p.p_name = c.name
UNION ALL SELECT c.name, 1, p.p_partkey FROM calls c JOIN part p ON c.name = p.p_brand || '.' || p.p_type)
SELECT name, CAST(tier AS INTEGER) AS tier, k AS target FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, k) AS r FROM hits) WHERE r = 1""", graph=False)
def match_name_tiers(spark, sf):
    part = load(spark, sf, "part")
    calls = part.select(F.when(F.expr("p_partkey % 2 = 0"), F.col("p_name")).otherwise(F.concat_ws(".", "p_brand", "p_type")).alias("name")).union(load(spark, sf, "customer").select("c_name"))
    return match.match_procedures(calls, part.select(F.col("p_name").alias("node_name"), F.col("p_brand").alias("router"), F.col("p_type").alias("procedure"), F.col("p_partkey").alias("target"), F.col("p_partkey").alias("ord")))


# Traversals


_AFFECTED = """WITH walk(id, depth) AS (SELECT 'service:nation:NATION_3', 0
UNION SELECT e.source, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT source, target FROM edges WHERE type IN ('calls_api', 'handles', 'calls_service', 'queries_db')) e ON e.target = w.id
WHERE w.depth <= 10 AND NOT starts_with(w.id, 'page:'))
SELECT DISTINCT n.id, n.name FROM walk w JOIN nodes n ON n.id = w.id WHERE n.type = 'page'"""


@query(_AFFECTED)
def affected_pages(spark, sf):
    return traverse.affected_pages(_graph(spark, sf), "service:nation:NATION_3").select("id", "name")


@query(f"""WITH {_KEPT}, walk(id, parent, depth) AS (SELECT 'page:customer:' || (SELECT min(c_name) FROM customer JOIN orders ON o_custkey = c_custkey), CAST(NULL AS STRING), 0
UNION ALL SELECT k.target, w.id, w.depth + 1 FROM walk w JOIN kept k ON k.source = w.id AND k.type = 'renders' WHERE w.depth < 3) SELECT id, parent AS parent_id, CAST(depth AS INTEGER) AS depth FROM walk""")
def subtree_rows(spark, sf):
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    root = "page:customer:" + (customers.join(orders, customers.c_custkey == orders.o_custkey).agg(F.min("c_name")).first()[0] or "")
    return traverse.subtree(_graph(spark, sf), root, "renders", 3).select("id", "parent_id", "depth")


@query("""WITH q AS (SELECT DISTINCT source AS caller, target AS model_id FROM edges WHERE type = 'queries_db'),
h AS (SELECT DISTINCT source AS handler, target AS caller FROM edges WHERE type = 'calls_service'),
r AS (SELECT DISTINCT source AS route, target AS handler FROM edges WHERE type = 'handles' AND source IN (SELECT id FROM nodes)),
m AS (SELECT DISTINCT model_id, route FROM q JOIN h USING (caller) JOIN r USING (handler)),
c AS (SELECT DISTINCT target AS route, source AS component FROM edges WHERE type = 'calls_api' AND source IN (SELECT id FROM nodes WHERE type = 'component'))
SELECT id AS model_id, count(DISTINCT m.route) AS total_routes, count(DISTINCT c.component) AS total_components FROM nodes LEFT JOIN m ON m.model_id = id LEFT JOIN c USING (route) WHERE type = 'db_model' GROUP BY id""")
def all_model_totals(spark, sf):
    return traverse.model_totals(_graph(spark, sf))


@query("""WITH q AS (SELECT source AS caller, target AS model_id FROM edges WHERE type = 'queries_db' AND target = 'db_model:region:ASIA'),
h AS (SELECT DISTINCT source AS handler, target AS caller FROM edges WHERE type = 'calls_service'),
r AS (SELECT DISTINCT source AS route, target AS handler FROM edges WHERE type = 'handles' AND source IN (SELECT id FROM nodes)),
m AS (SELECT DISTINCT model_id, route FROM q JOIN h USING (caller) JOIN r USING (handler)),
f AS (SELECT model_id, model_id AS from_id, caller AS to_id, 'prisma_result' AS transfer_method FROM q
UNION ALL SELECT model_id, e.target, route, 'return_type' FROM m JOIN edges e ON e.source = route AND e.type = 'handles'
UNION ALL SELECT model_id, route, e.source, 'hook_data' FROM m JOIN edges e ON e.target = route AND e.type = 'calls_api' AND e.source IN (SELECT id FROM nodes WHERE type = 'component'))
SELECT transfer_method, from_id, to_id, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def model_dataflow(spark, sf):
    g = _graph(spark, sf)
    flows = traverse.model_flows(g, g.nodes.where("id = 'db_model:region:ASIA'"))
    return flows.groupBy("transfer_method", "from_id", "to_id").agg(F.count("*").alias("n"))


_LINKS = ", ".join(f"'{t}'" for t in sorted(LINK_EDGES))


@query(f"""WITH f AS MATERIALIZED (SELECT source, target, min(struct_pack(a := o1, b := o2, c := o3, d := o4, via := type)) AS o FROM edges
WHERE type IN ({_LINKS}) AND source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY source, target),
up(root, here, seen, k) AS (SELECT id, id, [id], 0 FROM nodes WHERE type = 'handler'
UNION ALL SELECT root, n.id, list_append(seen, n.id), k + 1 FROM (SELECT w.root, w.seen, w.k, min(struct_pack(o := f.o, id := f.source)) AS n FROM up AS w JOIN f ON f.target = w.here WHERE w.k < 63 AND NOT list_contains(w.seen, f.source) GROUP BY w.root, w.seen, w.k)),
tops AS (SELECT root, arg_max(seen, k) AS seen, max(k) AS ups FROM up GROUP BY root),
down(root, here, seen, k, ups) AS (SELECT root, root, seen, ups, ups FROM tops
UNION ALL SELECT root, n.id, list_append(seen, n.id), k + 1, ups FROM (SELECT w.root, w.seen, w.k, w.ups, min(struct_pack(o := f.o, id := f.target)) AS n FROM down AS w JOIN f ON f.source = w.here WHERE w.k < 63 AND NOT list_contains(w.seen, f.target) GROUP BY w.root, w.seen, w.k, w.ups)),
whole AS (SELECT root, list_concat(list_reverse(arg_max(seen, k)[:ups + 1]), arg_max(seen, k)[ups + 2:]) AS path FROM down GROUP BY root, ups),
steps AS (SELECT root, generate_subscripts(path, 1) AS i, path FROM whole)
SELECT s.root, CAST(s.i AS INTEGER) AS index, s.path[s.i] AS node_id, f.o.via AS edge_from_prev FROM steps AS s LEFT JOIN f ON s.i > 1 AND f.source = s.path[s.i - 1] AND f.target = s.path[s.i]""")
def linear_trace(spark, sf):
    """Of each handler over the whole graph and all link types."""
    g = _graph(spark, sf)
    return traverse.linear_traces(g, g.nodes.where("type = 'handler'").select("id")).select("root", "index", "node_id", "edge_from_prev")


@query(f"""WITH RECURSIVE e AS ({derived.text(derived.IMPORTS)}), r(a, b) AS (SELECT source, target FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b),
same AS (SELECT x.a AS id, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT id, min(other) AS component FROM same GROUP BY id HAVING count(DISTINCT other) > 1""", graph=False)
def scc_imports(spark, sf):
    return traverse.strong_components(derived.run(spark, sf, derived.IMPORTS))


@query("""WITH f AS (SELECT source, target, type FROM edges WHERE source = 'service:nation:NATION_3' OR target = 'service:nation:NATION_3'),
ids AS (SELECT source AS id FROM f UNION SELECT target FROM f UNION SELECT 'service:nation:NATION_3') SELECT id, type FROM nodes WHERE id IN (SELECT id FROM ids)""")
def focus_graph(spark, sf):
    return traverse.focus(_graph(spark, sf), "service:nation:NATION_3").nodes.select("id", "type")


@query("""SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM nodes WHERE file_path LIKE 'backend/nation%' OR file_path LIKE 'backend/src/nation/%')
AND target IN (SELECT id FROM nodes WHERE file_path LIKE 'backend/src/nation/%') UNION ALL SELECT id, id, 'node' FROM nodes WHERE file_path LIKE 'backend/src/nation/%'""")
def focus_scope(spark, sf):
    g = traverse.view(_graph(spark, sf), "architecture", "focus", "module:workbench/backend/nation:nation")
    return g.edges.select("source", "target", "type").union(g.nodes.select("id", "id", F.lit("node")))


@query("""SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT source FROM edges UNION SELECT target FROM edges) GROUP BY type""")
def request_view(spark, sf):
    return traverse.request_view(_graph(spark, sf)).nodes.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT source, target, type FROM edges WHERE type = 'queries_db'")
def data_view(spark, sf):
    return traverse.data_view(_graph(spark, sf)).edges.select("source", "target", "type")


@query("""WITH s AS (SELECT id, type, file_path, split_part(file_path, '/', 1) AS root, CASE WHEN file_path LIKE 'backend/src/%/%' THEN 'backend/' || split_part(file_path, '/', 3)
WHEN file_path LIKE '%/%/%' THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) ELSE split_part(file_path, '/', 1) END AS leaf FROM nodes),
scopes AS (SELECT root AS scope FROM s UNION SELECT leaf FROM s)
SELECT scope, count(id) AS child_count, count(DISTINCT type) AS child_types FROM scopes LEFT JOIN s ON starts_with(file_path, scope || '/') OR file_path = scope GROUP BY scope""")
def module_overview(spark, sf):
    modules, _ = traverse.module_overview(_graph(spark, sf))
    return modules.select("scope", "child_count", F.size("child_types").cast("long").alias("child_types"))


@query("""WITH s AS (SELECT id, CASE WHEN file_path LIKE 'backend/src/%/%' THEN 'backend/' || split_part(file_path, '/', 3)
WHEN file_path LIKE '%/%/%' THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) ELSE split_part(file_path, '/', 1) END AS leaf FROM nodes)
SELECT DISTINCT a.leaf AS from_scope, b.leaf AS to_scope, e.type FROM edges e JOIN s a ON a.id = e.source JOIN s b ON b.id = e.target WHERE a.leaf <> b.leaf
UNION SELECT split_part(leaf, '/', 1), leaf, 'contains' FROM s WHERE contains(leaf, '/')""")
def module_edges(spark, sf):
    return traverse.module_overview(_graph(spark, sf))[1]


# Test intelligence: conversations as suites, turns as cases, system turns as fixtures, labels as coverage.


def _tests(spark, sf) -> Graph:
    c = load(spark, sf, "conversations").withColumn("conv", F.col("conv_id").cast("string")).withColumn("t", F.col("turn").cast("string"))
    node = lambda df, kind, id_, name, path, meta: df.select(id_.alias("id"), F.lit(kind).alias("type"), name.alias("name"), path.alias("file_path"), meta.alias("metadata"))
    suite_id, case_id = F.concat(F.lit("test_suite:"), "conv"), F.concat_ws(":", F.lit("test_case"), "conv", "t")
    framework = F.when(F.expr("conv_id % 3 = 0"), "jest").otherwise("vitest")
    meta = F.to_json(F.struct(framework.alias("framework"), F.expr("turn % 4 = 3").alias("disabled")))
    path = F.concat(F.lit("tests/"), "conv", F.lit(".ts"))
    nodes = node(c.select("conv", "conv_id", F.lit(0).alias("turn")).distinct(), "test_suite", suite_id, F.col("conv"), path, meta)
    nodes = nodes.unionByName(node(c.where("role <> 'system'"), "test_case", case_id, F.concat_ws(" > ", "conv", "t"), path, meta))
    nodes = nodes.unionByName(node(c.where("role = 'system'"), "test_fixture", F.concat_ws(":", F.lit("test_fixture"), "conv", "t"), F.col("t"), path, meta))
    docs = load(spark, sf, "documents").select(F.concat(F.lit("service:"), F.col("doc_id").cast("string")).alias("id"), F.lit("service").alias("type"), F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("src/"), "source").alias("file_path"), F.lit("{}").alias("metadata"))
    edge = lambda df, kind, s, t: df.select(F.concat_ws("--", s, F.lit(kind), t).alias("id"), s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), F.lit("certain").alias("confidence"), F.lit("{}").alias("metadata"))
    cases = c.where("role <> 'system'")
    edges = edge(cases, "tests", suite_id, case_id).unionByName(edge(cases.where("turn % 2 = 0"), "covers", case_id, F.concat(F.lit("service:"), (F.col("conv_id") % 200).cast("string"))))
    return Graph(nodes.unionByName(docs), edges)


@query("""SELECT count(DISTINCT conv_id) AS suites, count(*) FILTER (role <> 'system') AS cases, count(*) FILTER (role = 'system') AS fixtures,
count(DISTINCT CASE WHEN role <> 'system' AND turn % 2 = 0 THEN conv_id % 200 END) AS covered_targets,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT conv_id % 200 FROM conversations WHERE role <> 'system' AND turn % 2 = 0)) AS uncovered_targets FROM conversations""", graph=False)
def test_summary(spark, sf):
    return coverage.project(_tests(spark, sf)).summary


@query("""SELECT f.framework, count(c.conv_id) AS n FROM (SELECT unnest(['vitest', 'jest', 'playwright', 'cypress', 'junit4', 'junit5', 'kotest']) AS framework) f
LEFT JOIN conversations c ON c.role <> 'system' AND f.framework = CASE WHEN conv_id % 3 = 0 THEN 'jest' ELSE 'vitest' END GROUP BY 1""", graph=False)
def test_frameworks(spark, sf):
    return coverage.project(_tests(spark, sf)).by_framework


@query("""SELECT 'test_suite:' || CAST(conv_id AS STRING) AS suite_id, count(*) FILTER (role <> 'system' AND turn % 4 <> 3) AS n_cases, count(*) FILTER (role = 'system') AS n_fixtures
FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id HAVING count(*) FILTER (role <> 'system' AND turn % 4 <> 3) > 0""", graph=False)
def suite_groups(spark, sf):
    groups = coverage.suite_groups(_tests(spark, sf), "jest", "enabled")
    return groups.select("suite_id", F.size("cases").cast("long").alias("n_cases"), F.size("fixtures").cast("long").alias("n_fixtures"))


@query("""SELECT 'tests' AS type, count(*) AS n FROM conversations WHERE role <> 'system' UNION ALL SELECT 'covers', count(*) FROM conversations WHERE role <> 'system' AND turn % 2 = 0""", graph=False)
def test_view_graph(spark, sf):
    return traverse.test_graph(_tests(spark, sf)).edges.groupBy("type").agg(F.count("*").alias("n"))


# Scalar functions


@query("""SELECT id, split_part(id, ':', 1) AS type, split_part(id, ':', 2) AS file_path, split_part(id, ':', 3) AS name FROM nodes""")
def scalar_ids(spark, sf):
    return _graph(spark, sf).nodes.select("id", C.node_id_parts("id").alias("p")).select("id", "p.*")


@query("""SELECT source || '--' || type || '--' || target AS id, source, type, target FROM edges""")
def scalar_edge_ids(spark, sf):
    return _graph(spark, sf).edges.select("id", C.edge_id_parts("id").alias("p")).select("id", "p.*")


@query("""SELECT page_id, CASE WHEN starts_with(u, '/') THEN u ELSE '/' || u END AS normal, regexp_extract(u, '([^/]+)/*$', 1) AS last FROM (SELECT page_id, regexp_replace(split_part(url, '?', 1), '/$', '') AS u FROM pages)""", graph=False)
def scalar_urls(spark, sf):
    return load(spark, sf, "pages").select("page_id", C.normalize_url("url").alias("normal"), C.last_segment(C.normalize_url("url")).alias("last"))


@query("""SELECT id, split_part(file_path, '/', 1) AS root, CASE WHEN file_path LIKE 'backend/src/%/%' THEN 'backend/' || split_part(file_path, '/', 3)
WHEN file_path LIKE '%/%/%' THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) ELSE split_part(file_path, '/', 1) END AS leaf FROM nodes""")
def scalar_paths(spark, sf):
    return _graph(spark, sf).nodes.select("id", C.directory_scope("file_path").alias("s")).select("id", "s.*")


@query("""SELECT doc_id, CAST(length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) + 1 AS INTEGER) AS line FROM documents""", graph=False)
def line_of_offset(spark, sf):
    return load(spark, sf, "documents").select("doc_id", C.line_of("text", F.lit(500)).alias("line"))


@query("""SELECT type, CASE WHEN type IN ('page', 'component') THEN 'frontend' WHEN type = 'api_route' THEN 'api' WHEN type IN ('handler', 'service') THEN 'logic' WHEN type = 'db_model' THEN 'data' ELSE 'other' END AS layer, count(*) AS n FROM nodes GROUP BY 1, 2""")
def layer_counts(spark, sf):
    return _graph(spark, sf).nodes.groupBy("type", C.trace_layer("type").alias("layer")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages""", graph=False)
def page_links(spark, sf):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    return load(spark, sf, "pages").select("page_id", links.alias("link"))


# More lookups, joins and functions


@query("SELECT id FROM nodes WHERE file_path = 'backend/src/part/r3.ts' ORDER BY o1, o2 LIMIT 1")
def find_by_file(spark, sf):
    return lookup.find_by_file(_graph(spark, sf), "backend/src/part/r3.ts").select("id")


@query("SELECT id FROM nodes WHERE name = 'NATION_7' ORDER BY o1, o2 LIMIT 1")
def find_by_name(spark, sf):
    return lookup.find_by_name(_graph(spark, sf), "NATION_7").select("id")


@query("SELECT source, target, type FROM edges WHERE source = 'service:nation:NATION_3' OR target = 'service:nation:NATION_3'")
def edges_of_node(spark, sf):
    return lookup.edges_of(_graph(spark, sf), "service:nation:NATION_3").select("source", "target", "type")


@query("SELECT a.id AS source, b.id AS target FROM nodes a JOIN nodes b ON a.type = 'page' AND b.type = 'component' AND json_extract_string(b.metadata, '$.isPage') = 'true' AND 'shop/orders/c' || split_part(split_part(a.file_path, '/p', 2), '.', 1) || '.tsx' = b.file_path")
def page_components(spark, sf):
    g = _graph(spark, sf)
    pages = g.nodes.where("type = 'page'").withColumn("file_path", F.regexp_replace("file_path", "^shop/customer/p", "shop/orders/c"))
    return joins.page_components(Graph(pages.unionByName(g.nodes.where("type <> 'page'")), g.edges))


@query("""WITH uses AS (SELECT s_suppkey AS source, 'shop/orders/c' || CAST(s_suppkey - s_suppkey % 8 AS STRING) || '.tsx' AS place, CAST(s_suppkey + s_suppkey % 2 AS STRING) AS tag FROM supplier),
imports AS (SELECT DISTINCT 'shop/orders/c' || CAST(o_orderkey - o_orderkey % 8 AS STRING) || '.tsx' AS place, CAST(o_orderkey + o_orderkey % 2 AS STRING) AS tag FROM orders)
SELECT source, id AS target, tag FROM (SELECT u.source, n.id, u.tag, row_number() OVER (PARTITION BY u.source, u.tag ORDER BY (n.file_path = u.place), n.o1, n.o2) AS k
FROM uses u JOIN imports USING (place, tag) JOIN nodes n ON n.name = u.tag AND n.type = 'component') WHERE k = 1""")
def component_uses(spark, sf):
    at = lambda c: F.concat(F.lit("shop/orders/c"), (F.col(c) - F.col(c) % 8).cast("string"), F.lit(".tsx")).alias("file_path")
    uses = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), at("s_suppkey"), (F.col("s_suppkey") + F.col("s_suppkey") % 2).cast("string").alias("tag"))
    imports = load(spark, sf, "orders").select(at("o_orderkey"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).cast("string").alias("tag"))
    return joins.component_uses(uses, imports, _graph(spark, sf))


@query("SELECT source, target, type FROM edges WHERE (source = 'service:nation:NATION_3' AND target LIKE 'db_model:%' AND target = (SELECT 'db_model:region:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'))")
def edges_between(spark, sf):
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    name = nation.where("n_name = 'NATION_3'").join(region, nation.n_regionkey == region.r_regionkey).select("r_name").first()[0]
    return joins.between(_graph(spark, sf), f"db_model:region:{name}", "service:nation:NATION_3").select("source", "target", "type")


@query("""WITH f AS (SELECT p_brand, '/' || p_type || '/' || CAST(p_partkey AS STRING) || '/page.tsx' AS rest FROM part)
SELECT 'root/' || p_brand || rest AS path, 'root/' || p_brand || '/layout.tsx' AS layout FROM f UNION ALL SELECT 'root/bare ' || p_brand || rest, 'root/layout.tsx' FROM f""", graph=False)
def nearest_layout(spark, sf):
    """Every part's page, once in a folder with a layout of its brand and once in one without."""
    part = load(spark, sf, "part")
    file = lambda brand: part.select(F.concat_ws("/", F.lit("root"), brand, "p_type", F.col("p_partkey").cast("string"), F.lit("page.tsx")).alias("path"))
    own = part.select(F.concat_ws("/", F.lit("root"), "p_brand", F.lit("layout.tsx")).alias("path")).distinct()
    return traverse.nearest_layout(file(F.col("p_brand")).union(file(F.concat(F.lit("bare "), "p_brand"))), own.union(spark.sql("SELECT 'root/layout.tsx'")))


@query("SELECT c_custkey, '/' || lower(c_mktsegment) || '/[id]' AS app, '/' || lower(c_mktsegment) AS pages FROM customer", graph=False)
def file_routes(spark, sf):
    segment = F.lower("c_mktsegment")
    app = F.concat(F.lit("src/app/(shop)/"), segment, F.lit("/[id]/page.tsx"))
    pages = F.concat(F.lit("pages/"), segment, F.lit("/index.tsx"))
    rows = load(spark, sf, "customer").select("c_custkey", app.alias("a"), pages.alias("p"))
    return rows.select("c_custkey", C.app_route("a").alias("app"), C.pages_route("p").alias("pages"))


@query("SELECT p_partkey, replace(p_brand, 'Brand#', 'Brand') || upper(left(p_type, 1)) || substr(split_part(p_type, ' ', 1), 2) AS pascal, '/' || p_brand || '/' || CAST(p_size AS STRING) AS route FROM part", graph=False)
def scalar_names(spark, sf):
    part = load(spark, sf, "part").withColumn("word", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return part.select("p_partkey", C.pascal_case(F.concat_ws("-", "p_brand", "word")).alias("pascal"), C.join_route(F.concat("p_brand", F.lit("/")), F.concat(F.lit("//"), F.col("p_size").cast("string"), F.lit("/"))).alias("route"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]+/(en|fr)/') AS public, regexp_matches(html, '(?i)\\b(auth|verify|checkAuth)\\s*\\(') AS guarded FROM pages", graph=False)
def route_predicates(spark, sf):
    pages = load(spark, sf, "pages")
    as_api = F.regexp_replace("url", "^https?://[^/]+/(?:en|fr)/", "/api/public/")
    return pages.select("page_id", C.is_public_route(as_api).alias("public"), C.has_auth("html").alias("guarded"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'client' WHEN doc_id % 3 = 1 THEN 'server' END AS directive FROM documents", graph=False)
def file_directives(spark, sf):
    head = F.when(F.expr("doc_id % 3 = 0"), F.lit("  \n'use client'\n")).when(F.expr("doc_id % 3 = 1"), F.lit('"use server";')).otherwise(F.lit("// 'use client'\n"))
    return load(spark, sf, "documents").select("doc_id", C.directive(F.concat(head, "text")).alias("directive"))


@query("SELECT CASE WHEN conv_id % 4 = 0 THEN 'failed' WHEN conv_id % 4 = 1 THEN 'skipped' ELSE 'passed' END AS status, turn FROM conversations", graph=False)
def result_rows(spark, sf):
    status = F.when(F.expr("conv_id % 4 = 0"), "failed").when(F.expr("conv_id % 4 = 1"), "skipped").otherwise("passed")
    return load(spark, sf, "conversations").select(status.alias("status"), "turn")


@query("""SELECT count(*) AS total, count(*) FILTER (conv_id % 4 > 1) AS passed, count(*) FILTER (conv_id % 4 = 0) AS failed, count(*) FILTER (conv_id % 4 = 1) AS skipped, CAST(sum(turn) AS DOUBLE) AS duration_ms FROM conversations""", graph=False)
def import_totals(spark, sf):
    return stats.import_totals(result_rows(spark, sf).withColumn("duration_ms", F.col("turn").cast("double")))


@query(f"WITH {_ALL}, issues AS ({_ISSUES}) SELECT severity, 'consistency' AS source, count(*) AS n FROM issues GROUP BY severity UNION ALL SELECT 'error', 'parser', count(*) FROM region")
def findings_by_source(spark, sf):
    errors = load(spark, sf, "region").select(F.col("r_name").alias("file"), F.lit("unreadable").alias("message"), F.lit("error").alias("severity"), F.lit("x").alias("parser"), F.lit(None).cast("string").alias("code"))
    return detect.findings_by(detect.findings(errors, _some_issues(spark, sf)))


@query(f"WITH {_ALL}, issues AS ({_ISSUES}) SELECT type, count(*) AS n FROM issues GROUP BY type")
def issues_deduplicated(spark, sf):
    twice = _some_issues(spark, sf)
    return detect.dedup_issues(twice.unionByName(twice)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT -1 - o_orderkey AS id FROM orders", graph=False)
def new_nodes(spark, sf):
    """Orders against orders and as many that weren't there."""
    before = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return dedup.new_nodes(before, before.union(before.select((-1 - F.col("id")).alias("id"))))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def event_windows(spark, sf):
    counts = watch.event_counts(load(spark, sf, "events"), "1 hour")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", graph=False)
def event_sessions(spark, sf):
    return watch.user_sessions(load(spark, sf, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, count(*) <= 1 AS allowed FROM events GROUP BY 1, 2", graph=False)
def request_limits(spark, sf):
    return watch.request_limits(load(spark, sf, "events"), 1, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n FROM nation", graph=False)
def table_digest(spark, sf):
    """The digest doesn't change with the partitions; the count is what another engine can tell."""
    nation = load(spark, sf, "nation")
    both = [stats.table_digest(df, ["n_nationkey", "n_name"]) for df in (nation, nation.repartition(7))]
    return both[0].intersect(both[1]).select("n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
