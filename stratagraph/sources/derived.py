"""A graph derived from the star-schema test tables: customer > orders > part > supplier > nation > region stand for page,
component, API route, handler, service and model. One SQL text serves Spark and the comparison engine alike.

Files hold a few nodes each, however large the tables are, so what is paired within a file grows with the tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import load

NODES = """
SELECT 'page:customer:' || c_name AS id, 'page' AS type, c_name AS name, 'shop/customer/p' || CAST(c_custkey - c_custkey % 8 AS STRING) || '.tsx' AS file_path,
       '{"route":"/customer/' || CAST(c_custkey AS STRING) || '"}' AS metadata, 1 AS o1, c_custkey AS o2 FROM {customer}
UNION ALL
SELECT 'component:orders:' || CAST(o_orderkey AS STRING), 'component', CAST(o_orderkey AS STRING), 'shop/orders/c' || CAST(o_orderkey - o_orderkey % 8 AS STRING) || '.tsx',
       '{"isPage":' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END || '}', 2, o_orderkey FROM {orders}
UNION ALL
SELECT 'api_route:part:' || CAST(p_partkey AS STRING), 'api_route', p_name, 'backend/src/part/r' || CAST(p_partkey % 20 AS STRING) || '.ts',
       '{"method":"' || CASE WHEN p_size % 3 = 0 THEN 'GET,POST' WHEN p_size % 3 = 1 THEN 'GET' ELSE 'ALL' END || '","route":"/api/part/' || CAST(p_partkey AS STRING) || '/"}', 3, p_partkey FROM {part}
UNION ALL
SELECT 'handler:supplier:' || s_name, 'handler', s_name, 'backend/src/supplier/h' || CAST(s_suppkey - s_suppkey % 4 AS STRING) || '.ts', '{}', 4, s_suppkey FROM {supplier}
UNION ALL
SELECT 'service:nation:' || n_name, 'service', n_name, 'backend/src/nation/' || n_name || '.ts', '{}', 5, CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT 'db_model:region:' || r_name, 'db_model', r_name, 'schema/region.prisma', '{"tableName":"' || lower(r_name) || 's","fieldCount":2}', 6, CAST(r_regionkey AS BIGINT) FROM {region}
"""

EDGES = """
SELECT 'page:customer:' || c_name AS source, 'component:orders:' || CAST(o_orderkey AS STRING) AS target, 'renders' AS type, 'certain' AS confidence, '{}' AS metadata,
       1 AS o1, o_orderkey AS o2, CAST(0 AS BIGINT) AS o3, CAST(0 AS BIGINT) AS o4 FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT 'component:orders:' || CAST(l_orderkey AS STRING), 'api_route:part:' || CAST(l_partkey AS STRING), 'calls_api', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'certain' END,
       '{"method":"' || CASE WHEN l_linenumber = 1 THEN 'POST' ELSE 'GET' END || '","callLine":' || CAST(l_linenumber AS STRING) || '}',
       2, l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey, l_suppkey FROM {lineitem}
UNION ALL
SELECT 'page:customer:' || c_name, 'api_route:part:' || CAST(l_partkey AS STRING), 'calls_api', 'inferred', '{"method":"GET"}', 3, l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey, l_suppkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'
UNION ALL
SELECT 'api_route:part:' || CAST(l_partkey AS STRING), 'handler:supplier:' || s_name, 'handles', CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'certain' END, '{}',
       4, l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey, l_suppkey FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
UNION ALL
SELECT 'handler:supplier:' || s_name, 'service:nation:' || n_name, 'calls_service', 'certain', '{}', 5, s_suppkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT 'page:customer:' || c_name, 'component:gone:' || CAST(c_custkey AS STRING), 'renders', 'inferred', '{}', 7, c_custkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {customer}
UNION ALL
SELECT 'component:gone:' || CAST(s_suppkey AS STRING), 'api_route:part:' || CAST(s_suppkey AS STRING), 'calls_api', 'inferred', '{"method":"GET"}', 8, s_suppkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {supplier}
UNION ALL
SELECT 'service:nation:' || n_name, 'db_model:region:' || r_name, 'queries_db', 'certain', '{}', 6, CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

#: Nodes without edges beside the graph: a route, a component and a service for each nation.
LONE = " UNION ALL ".join(
    f"""SELECT '{kind}:lone:' || n_name AS id, '{kind}' AS type, n_name AS name, 'lone/' || n_name || '.ts' AS file_path, '{{"method":"GET","route":"/lone/' || n_name || '"}}' AS metadata, 9 AS o1, CAST(n_nationkey AS BIGINT) AS o2 FROM {{nation}}"""
    for kind in ("api_route", "component", "service")
)

#: Suppliers that import each other, s to s * s + 1 by the number of suppliers: cycles exist.
IMPORTS = """
SELECT 'module:supplier:' || CAST(s_suppkey AS STRING) AS source, 'module:supplier:' || CAST((s_suppkey * s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS STRING) AS target FROM {supplier}
"""

#: Transitions between a user's events: self loops and cycles.
TRANSITIONS = """
SELECT source, target, o2 FROM (SELECT 'module:events:' || event_type AS source, 'module:events:' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, event_id AS o2 FROM {events}) AS t
WHERE target IS NOT NULL
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")


def text(sql: str) -> str:
    """The SQL over the plain table names."""
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of a folder."""
    used = {t: load(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql}
    names = {}
    for t, df in used.items():
        names[t] = f"derived_{t}"
        df.createOrReplaceTempView(names[t])
    for t, name in names.items():
        sql = sql.replace("{" + t + "}", name)
    return spark.sql(sql)


def graph(spark: SparkSession, sf_dir: str, lone: bool = False) -> Graph:
    """The derived graph; it is not sanitized: it has dangling and repeated edges. lone: with the nodes of LONE."""
    nodes = run(spark, sf_dir, f"{NODES} UNION ALL {LONE}" if lone else NODES)
    ord_ = lambda *c: F.struct(*[F.coalesce(F.col(x) if x else F.lit(0), F.lit(0)).cast("long").alias(n) for x, n in zip(c, ("stage", "file", "parser", "emit"))])
    nodes = nodes.select("id", "type", "name", "file_path", F.lit(1).alias("line"), F.lit(1).alias("column"), "metadata", ord_("o1", "o2", "", "").alias("ord"))
    edges = run(spark, sf_dir, EDGES)
    edges = edges.select(F.concat_ws("--", "source", "type", "target").alias("id"), "source", "target", "type", "confidence", "metadata", ord_("o1", "o2", "o3", "o4").alias("ord"))
    return Graph(nodes, edges)
