"""The registered queries of linking and rule operators over rows made from whole tables, each with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import detect, joins, match
from .sources import derived

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL; {name} stands for the inputs below."""

    def add(f):
        _QUERIES[f.__name__] = f
        inputs = {k: f"({derived.text(v)})" for k, v in _INPUTS.items()}
        _ORACLES[f.__name__] = sql.strip().format(**inputs)
        return f

    return add


_FILE = "'src/f' || CAST({0} - {0} % 4 AS STRING) || '.{1}'"
#: Rows that the operators take, as SQL for both engines: nodes and edges with the columns that the operators name, and facts.
_INPUTS = {
    "parts": f"""SELECT 'component:' || {_FILE.format('o_orderkey', 'tsx')} || ':' || CAST(o_orderkey AS STRING) AS id, 'component' AS type, CAST(o_orderkey AS STRING) AS name, {_FILE.format('o_orderkey', 'tsx')} AS file_path,
'{{"isPage":' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END || '}}' AS metadata, o_orderkey AS o FROM {{orders}}""",
    "lost_calls": f"""SELECT 'call:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS id, 'gone:' || {_FILE.format('l_orderkey', 'tsx')} || ':' || CAST(l_linenumber AS STRING) AS source,
'api_route:unknown:' || CAST(l_partkey AS STRING) AS target, 'calls_api' AS type, '{{}}' AS metadata, l_partkey AS o FROM {{lineitem}}""",
    "remote": "SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'proc' || CAST(l_suppkey AS STRING) WHEN 1 THEN 'n' || CAST(l_partkey % 25 AS STRING) || '.p' || CAST(l_suppkey % 50 AS STRING) WHEN 2 THEN 'n' || CAST(l_partkey % 25 AS STRING) || '.p' || CAST(l_suppkey % 50 AS STRING) || '.more' ELSE 'n' || CAST(l_partkey AS STRING) || '.' END AS name FROM {lineitem}",
    "procedures": "SELECT 'proc' || CAST(s_suppkey - s_suppkey % 2 AS STRING) AS node_name, 'n' || CAST(s_nationkey AS STRING) AS router, 'p' || CAST(s_suppkey % 40 AS STRING) AS procedure, 'target:' || CAST(s_suppkey AS STRING) AS target, s_suppkey AS ord FROM {supplier}",
    "kotlin": f"""SELECT kind || ':' || CAST(s_suppkey AS STRING) AS id, kind AS type, 'f' || CAST(s_suppkey % 2 AS STRING) AS name, {_FILE.format('s_suppkey', 'kt')} AS file_path,
CASE WHEN kind <> 'kotlin_class' THEN '{{}}' WHEN s_suppkey % 3 = 0 THEN '{{"annotations":["Service"]}}' ELSE '{{"annotations":["Repository"]}}' END AS metadata, s_suppkey AS o
FROM {{supplier}}, (SELECT 'kotlin_route' AS kind UNION ALL SELECT 'kotlin_function' UNION ALL SELECT 'kotlin_class' UNION ALL SELECT 'db_model') AS k""",
    "imports": f"SELECT DISTINCT {_FILE.format('o_orderkey', 'tsx')} AS file, {_FILE.format('o_custkey', 'tsx')} AS imported, './f' || CAST(o_custkey - o_custkey % 4 AS STRING) AS specifier, CAST(o_custkey % 90 AS INT) AS line FROM {{orders}}",
    "directives": f"SELECT DISTINCT {_FILE.format('c_custkey', 'tsx')} AS file, CASE WHEN c_custkey % 12 < 4 THEN 'client' ELSE 'server' END AS directive FROM {{customer}}",
    "served": f"""SELECT 'handler:' || CAST(s_suppkey AS STRING) AS id, 'handler' AS type, 'GET' AS name, {_FILE.format('s_suppkey', 'ts')} AS file_path, '{{"routeId":"api_route:' || CAST(s_suppkey AS STRING) || '"}}' AS metadata, s_suppkey AS o FROM {{supplier}}
UNION ALL SELECT 'api_route:' || CAST(p_partkey AS STRING), 'api_route', p_name, {_FILE.format('p_partkey', 'ts')}, '{{"route":"' || CASE WHEN p_size % 5 = 0 THEN '/api/health/' ELSE '/api/part/' END || CAST(p_partkey AS STRING) || '"}}', p_partkey FROM {{part}}""",
    "bodies": """SELECT 'handler:' || CAST(s_suppkey AS STRING) AS node_id, CASE WHEN s_nationkey % 3 = 0 THEN 'const s = await getSession(req)' ELSE 'return auth.name' END AS text FROM {supplier}
UNION ALL SELECT 'api_route:' || CAST(p_partkey AS STRING), CASE WHEN p_size % 2 = 0 THEN 'requireAuth (x)' ELSE 'reverify(x)' END FROM {part}""",
    "loops": f"SELECT DISTINCT {_FILE.format('l_suppkey', 'ts')} AS file, l_linenumber * 1000 + CAST(l_partkey % 1000 AS INT) AS line, 'prisma.part.find' AS call FROM {{lineitem}}",
}


def _frame(spark, sf, name) -> DataFrame:
    """An input; nodes and edges get a line and an ordinal."""
    df = derived.run(spark, sf, _INPUTS[name])
    if "o" not in df.columns:
        return df
    zero = F.lit(0).cast("long")
    ordinal = F.struct(F.col("o").cast("long").alias("stage"), zero.alias("file"), zero.alias("parser"), zero.alias("emit"))
    return df.withColumns({"line": F.lit(1), "ord": ordinal}).drop("o")


def _graph(spark, sf, nodes: str, edges: str = "lost_calls") -> Graph:
    return Graph(_frame(spark, sf, nodes), _frame(spark, sf, edges))


@query("""WITH n AS {parts}, first AS (SELECT file_path, arg_min(id, (CASE WHEN json_extract_string(metadata, '$.isPage') = 'true' THEN 0 ELSE 1 END, o)) AS component FROM n GROUP BY file_path)
SELECT c.id AS edge_id, f.component AS source, c.target FROM {lost_calls} AS c JOIN first AS f ON f.file_path = split_part(c.source, ':', 2)""")
def repaired_sources(spark, sf):
    """Calls of nodes that aren't there go to the first component of their file."""
    return joins.repaired_sources(_graph(spark, sf, "parts"))


@query("""WITH p AS {procedures}, w AS {remote}, exact AS (SELECT w.name, 0 AS tier, arg_min(p.target, p.ord) AS target FROM w JOIN p ON p.node_name = w.name GROUP BY w.name),
pair AS (SELECT w.name, 1 AS tier, arg_min(p.target, p.ord) AS target FROM w JOIN p ON p.router = split_part(w.name, '.', 1) AND p.procedure = split_part(w.name, '.', 2) GROUP BY w.name)
SELECT name, CAST(min(tier) AS INTEGER) AS tier, arg_min(target, tier) AS target FROM (SELECT * FROM exact UNION ALL SELECT * FROM pair) GROUP BY name""")
def match_procedure_tiers(spark, sf):
    return match.match_procedures(_frame(spark, sf, "remote"), _frame(spark, sf, "procedures"))


@query("""WITH n AS {kotlin}, c AS (SELECT * FROM n WHERE type = 'kotlin_class'), s AS (SELECT file_path, min(o) AS o FROM c WHERE contains(metadata, 'Service') GROUP BY file_path)
SELECT a.id AS source, b.id AS target, 'handles' AS type FROM n AS a JOIN n AS b ON a.type = 'kotlin_route' AND b.type = 'kotlin_function' AND a.file_path = b.file_path AND a.name = b.name
UNION ALL SELECT a.id, 'kotlin_class:' || s.o, 'calls_service' FROM n AS a JOIN s ON a.type = 'kotlin_function' AND s.file_path = a.file_path
UNION ALL SELECT c.id, m.id, 'queries_db' FROM c JOIN n AS m ON m.type = 'db_model' AND m.file_path = c.file_path WHERE contains(c.metadata, 'Repository')""")
def kotlin_file_links(spark, sf):
    return joins.kotlin_links(_graph(spark, sf, "kotlin"))


@query("""WITH n AS {parts}, i AS {imports}, client AS (SELECT file FROM {directives} WHERE directive = 'client')
SELECT 'rsc-' || n.id || '-' || i.specifier AS id, i.file, i.line FROM i JOIN n ON n.file_path = i.file WHERE i.file NOT IN (SELECT file FROM client) AND i.imported IN (SELECT file FROM client)""")
def client_imports_of_servers(spark, sf):
    """Components of server files that import a client file."""
    found = detect.boundary_violations(_graph(spark, sf, "parts"), _frame(spark, sf, "imports"), _frame(spark, sf, "directives"))
    return found.select("id", F.col("locations")[0]["file"].alias("file"), F.col("locations")[0]["line"].alias("line"))


@query("""WITH n AS {served}, b AS {bodies}, h AS (SELECT DISTINCT file_path FROM n WHERE type = 'handler'), routes AS (SELECT id, file_path, json_extract_string(metadata, '$.route') AS route FROM n WHERE type = 'api_route'),
c AS (SELECT n.id, n.name, CASE WHEN n.type = 'handler' THEN r.route ELSE json_extract_string(n.metadata, '$.route') END AS route FROM n LEFT JOIN routes AS r ON n.type = 'handler' AND r.id = 'api_route:' || split_part(n.id, ':', 2) AND r.file_path = n.file_path
WHERE n.type = 'handler' OR n.file_path NOT IN (SELECT file_path FROM h))
SELECT 'unguarded-' || c.id AS id, coalesce(c.route, c.name) AS route FROM c JOIN b ON b.node_id = c.id WHERE b.text IN ('return auth.name', 'reverify(x)') AND NOT coalesce(starts_with(c.route, '/api/health'), false)""")
def unguarded_handlers(spark, sf):
    found = detect.unguarded_routes(_graph(spark, sf, "served"), _frame(spark, sf, "bodies"))
    return found.select("id", F.split("description", " ")[0].alias("route"))


@query("""WITH first AS (SELECT file_path, min(o) AS o FROM {served} WHERE type = 'handler' GROUP BY file_path)
SELECT 'n-plus-one-' || l.file || '-' || l.line AS id, 'handler:' || f.o AS owner FROM {loops} AS l JOIN first AS f ON f.file_path = l.file""")
def queries_in_loops(spark, sf):
    """Queries in loops, on the first handler of their file."""
    return detect.repeated_queries(_graph(spark, sf, "served"), _frame(spark, sf, "loops")).select("id", F.col("related_nodes")[0].alias("owner"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
