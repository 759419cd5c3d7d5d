"""Projections, filters and lookups. "First" is by ordinal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import slashes
from ..graph import Graph
from ..schema import CONFIDENCES, EDGE_METADATA, EDGE_TYPES, NODE_METADATA, NODE_TYPES, SEVERITIES, TEST_FRAMEWORKS


def node(graph: Graph, id_: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == id_)


def nodes_by_type(graph: Graph, *types: str) -> DataFrame:
    """Nodes of the given types; none given, none found."""
    unknown = set(types) - set(NODE_TYPES)
    if unknown:
        raise ValueError(f"unknown node type: {', '.join(sorted(unknown))}")
    return graph.nodes.where(F.col("type").isin(*types)) if types else graph.nodes.where(F.lit(False))


def nodes_by_file(graph: Graph, path: str) -> DataFrame:
    return graph.nodes.where(F.col("file_path") == path)


def edges_by_type(graph: Graph, *types: str) -> DataFrame:
    unknown = set(types) - set(EDGE_TYPES)
    if unknown:
        raise ValueError(f"unknown edge type: {', '.join(sorted(unknown))}")
    return graph.edges.where(F.col("type").isin(*types)) if types else graph.edges.where(F.lit(False))


def out_edges(graph: Graph, id_: str) -> DataFrame:
    return graph.edges.where(F.col("source") == id_)


def in_edges(graph: Graph, id_: str) -> DataFrame:
    return graph.edges.where(F.col("target") == id_)


def edges_of(graph: Graph, id_: str) -> DataFrame:
    return graph.edges.where((F.col("source") == id_) | (F.col("target") == id_))


def first(df: DataFrame, *order: str) -> DataFrame:
    """The first row by ordinal. A top-1, not a sort of everything."""
    return df.orderBy(*(order or ("ord",))).limit(1)


def route_of(metadata: str = "metadata") -> Column:
    return F.get_json_object(metadata, "$.route")


def field(df: DataFrame, name: str) -> Column:
    """A metadata field: its own column where the frame has one (snapshots do), so that filters reach the files; else from the
    JSON text."""
    return F.col(name) if name in df.columns else F.get_json_object("metadata", f"$.{name}")


def find_by_route(graph: Graph, route: str) -> DataFrame:
    return first(graph.nodes.where(field(graph.nodes, "route") == route))


def find_by_file(graph: Graph, path: str) -> DataFrame:
    return first(graph.nodes.where(F.col("file_path") == path))


def find_by_name(graph: Graph, name: str) -> DataFrame:
    return first(graph.nodes.where(F.col("name") == name))


def find_any(graph: Graph, query: str) -> DataFrame:
    """The first node by route; else by file; else by name. One scan."""
    tier = F.when(field(graph.nodes, "route") == query, 0).when(F.col("file_path") == query, 1).when(F.col("name") == query, 2)
    return first(graph.nodes.withColumn("tier", tier).where("tier is not null"), "tier", "ord").drop("tier")


def search(graph: Graph, query: str | None) -> DataFrame:
    """Nodes whose name or path holds the trimmed text, whatever the case; all for a blank one."""
    q = (query or "").strip().lower()
    return graph.nodes.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("file_path"), F.lit(q))) if q else graph.nodes


def visible_ids(graph: Graph, query: str | None) -> DataFrame | None:
    """Ids that a search shows, or None where a blank query filters nothing."""
    return search(graph, query).select("id") if (query or "").strip() else None


def induced(graph: Graph, ids: DataFrame | None) -> Graph:
    """The nodes in `ids` and the edges with both ends there."""
    if ids is None:
        return graph
    ids = ids.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges.select(*graph.edges.columns))


def facet_filter(graph: Graph, node_types=None, edge_types=None, confidences=None, hide_isolated: bool = False) -> Graph:
    """Nodes and edges by facet; isolated nodes are those without any edge of the whole graph."""
    nodes, edges = graph.nodes, graph.edges
    if node_types is not None:
        nodes = nodes.where(F.col("type").isin(*node_types)) if node_types else nodes.where(F.lit(False))
    if edge_types is not None:
        edges = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges.where(F.lit(False))
    if confidences is not None:
        edges = edges.where(F.col("confidence").isin(*confidences)) if confidences else edges.where(F.lit(False))
    if hide_isolated:
        ends = graph.edges.select("source").union(graph.edges.select("target")).toDF("id").distinct()
        nodes = nodes.join(ends, "id", "left_semi")
    shown = induced(Graph(nodes, edges), nodes.select("id"))
    return Graph(nodes, shown.edges)


_API_TYPES = ("api_route", "trpc_procedure", "tsrpc_service", "tsrpc_api", "express_route")


def api_routes(graph: Graph, text: str | None = None) -> DataFrame:
    """id, name, type, method, path of the API nodes, with their handlers and the models one hop away."""
    j = lambda field: F.get_json_object("metadata", f"$.{field}")
    method = F.when(F.col("type") == "trpc_procedure", F.upper(j("procedureType"))).when(F.col("type").isin("tsrpc_service", "tsrpc_api"), F.upper(j("transport"))).otherwise(j("method"))
    path = F.coalesce(j("route"), j("servicePath"), j("apiPath"), F.col("name"))
    routes = graph.nodes.where(F.col("type").isin(*_API_TYPES)).select("id", "name", "type", "file_path", method.alias("method"), path.alias("path"))
    if text:
        routes = routes.where(F.contains("name", F.lit(text)) | F.contains("path", F.lit(text)))
    names = graph.nodes.select(F.col("id").alias("target"), F.struct("id", "name").alias("node"))
    near = graph.edges.where(F.col("type").isin("handles", "queries_db")).join(names, "target")
    near = near.groupBy(F.col("source").alias("id")).agg(
        F.collect_set(F.when(F.col("type") == "handles", F.col("node"))).alias("handlers"), F.collect_set(F.when(F.col("type") == "queries_db", F.col("node"))).alias("models")
    )
    return routes.join(near, "id", "left")


def db_models(graph: Graph) -> DataFrame:
    j = lambda field: F.get_json_object("metadata", f"$.{field}")
    models = graph.nodes.where("type = 'db_model'")
    fields = F.from_json(j("fields"), "array<struct<name:string,type:string,isRequired:boolean,isId:boolean,isRelation:boolean>>")
    return models.select("id", "name", "file_path", j("tableName").alias("table_name"), F.coalesce(j("fieldCount").cast("int"), F.lit(0)).alias("field_count"), fields.alias("fields"))


def errors(parse_errors: DataFrame, file: str | None = None, severity: str | None = None) -> DataFrame:
    if severity is not None and severity not in ("error", *SEVERITIES):
        raise ValueError(f"unknown severity: {severity}")
    out = parse_errors if file is None else parse_errors.where(F.col("file") == file)
    return out if severity is None else out.where(F.col("severity") == severity)


def is_node_type(c: str = "type") -> Column:
    return F.coalesce(F.col(c).isin(*NODE_TYPES), F.lit(False))


def is_edge_type(c: str = "type") -> Column:
    return F.coalesce(F.col(c).isin(*EDGE_TYPES), F.lit(False))


def is_confidence(c: str = "confidence") -> Column:
    return F.coalesce(F.col(c).isin(*CONFIDENCES), F.lit(False))


def is_test_framework(c: str) -> Column:
    return F.coalesce(F.col(c).isin(*TEST_FRAMEWORKS), F.lit(False))


def typed_metadata(kind: str, spec: dict, column: str = "metadata") -> Column:
    """Schema on read: a struct of a type's metadata fields with conservative defaults; unreadable JSON counts as {}."""
    parsed = F.coalesce(F.try_parse_json(F.col(column)), F.parse_json(F.lit("{}")))
    out = []
    for name, what, default in spec[kind]:
        got = F.try_variant_get(parsed, f"$.{name}", "string" if isinstance(what, tuple) else what)
        if isinstance(what, tuple):
            value = F.when(got.isin(*what), got).otherwise(default)
        elif default is None:
            value = got
        else:
            value = F.coalesce(got, F.array().cast(what) if default == [] else F.lit(default))
        out.append(value.alias(name))
    return F.struct(*out)


def typed_nodes(graph: Graph, kind: str) -> DataFrame:
    """The nodes of a type with their metadata as typed columns."""
    return nodes_by_type(graph, kind).withColumn("meta", typed_metadata(kind, NODE_METADATA)).select("id", "name", "file_path", "line", "column", "meta.*")


def typed_edges(graph: Graph, kind: str) -> DataFrame:
    return edges_by_type(graph, kind).withColumn("meta", typed_metadata(kind, EDGE_METADATA)).select(F.col("id").alias("edge_id"), "source", "target", "confidence", "meta.*")


def coerced(graph: Graph, objects: bool = False) -> Graph:
    """Rows with unknown enums brought back into the model: types to module and imports, confidence to inferred.

    objects: the metadata of the edges is known to be JSON and isn't parsed again."""
    nodes = graph.nodes.withColumn("type", F.when(is_node_type(), F.col("type")).otherwise("module"))
    edges = graph.edges.withColumn("type", F.when(is_edge_type(), F.col("type")).otherwise("imports"))
    edges = edges.withColumn("confidence", F.when(is_confidence(), F.col("confidence")).otherwise("inferred"))
    fixed = F.when(F.try_parse_json("metadata").isNull(), "{}").otherwise(F.col("metadata"))
    return Graph(nodes.withColumn("metadata", fixed), edges if objects else edges.withColumn("metadata", fixed))


def valid_depth(value, fallback: int) -> int:
    """A depth argument: a whole number of 0 to 100, also as text; the fallback for None. Anything else is an error."""
    if value is None:
        return fallback
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError("depth must be a number")
    try:
        number = float(value)
    except ValueError:
        raise ValueError("depth must be a number") from None
    if not math.isfinite(number) or number != int(number) or not 0 <= number <= 100:
        raise ValueError("depth must be a whole number of 0 to 100")
    return int(number)


def ranked_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group by the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def normalized_paths(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("file_path", slashes("file_path"))
