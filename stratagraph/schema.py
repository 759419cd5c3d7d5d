"""The graph's data model: closed vocabularies, row types and ordinals."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's closed vocabularies, in their order.
NODE_TYPES = (
    "page", "component", "api_route", "trpc_procedure", "tsrpc_service", "tsrpc_api", "tsrpc_msg", "express_route", "handler", "service",
    "db_model", "module", "kotlin_class", "kotlin_interface", "kotlin_object", "kotlin_function", "kotlin_route", "test_suite", "test_case", "test_fixture",
)
EDGE_TYPES = (
    "renders", "navigates_to", "calls_api", "handles", "calls_service", "queries_db", "db_relation", "imports", "contains",
    "kotlin_inherits", "kotlin_implements", "kotlin_uses", "data_flows_to", "sends_msg", "listens_msg", "tests", "covers", "uses_fixture",
)
CONFIDENCES = ("certain", "inferred")
ISSUE_TYPES = (
    "dead_api_call", "unused_route", "method_mismatch", "missing_procedure", "param_mismatch", "dead_route", "dead_component", "dead_service",
    "circular_dependency", "n_plus_one_query", "unguarded_route", "rsc_boundary_violation",
)
SEVERITIES = ("critical", "warning", "info")
TEST_FRAMEWORKS = ("vitest", "jest", "playwright", "cypress", "junit4", "junit5", "kotest")
LAYERS = ("frontend", "api", "logic", "data", "other")
LAYER_OF = {
    "page": "frontend", "component": "frontend", "api_route": "api", "trpc_procedure": "api", "tsrpc_service": "api", "tsrpc_api": "api",
    "tsrpc_msg": "api", "express_route": "api", "kotlin_route": "api", "handler": "logic", "service": "logic", "db_model": "data",
}
LINK_EDGES = ("renders", "navigates_to", "calls_api", "handles", "calls_service", "queries_db", "data_flows_to", "sends_msg", "listens_msg")
DATA_EDGES = ("queries_db", "db_relation", "data_flows_to")
UPSTREAM_EDGES = ("calls_api", "handles", "calls_service", "queries_db")
ROUTE_TYPES = ("api_route", "trpc_procedure", "express_route")
TEST_TYPES = ("test_suite", "test_case", "test_fixture")

#: Stage, file, extractor and place within its output; "first" and "last" follow this order, as rows themselves have none.
ORD = T.StructType([T.StructField(n, T.LongType()) for n in ("stage", "file", "parser", "emit")])

NODE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("metadata", T.StringType()), T.StructField("ord", ORD),
])
EDGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("confidence", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("ord", ORD),
])
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "message", "severity", "parser", "code")])
LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("note", T.StringType())])
ISSUE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("type", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("message_key", T.StringType()), T.StructField("message_params", T.MapType(T.StringType(), T.StringType())), T.StructField("locations", T.ArrayType(LOCATION)),
    T.StructField("related_nodes", T.ArrayType(T.StringType())), T.StructField("related_edges", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()),
])

# Metadata fields by type as (name, kind, default); kinds are Spark types or the allowed literals. A missing or
# bad literal becomes the first listed.
_FRAMEWORK = ("framework", TEST_FRAMEWORKS, "vitest")
NODE_METADATA = {
    "page": [("route", "string", ""), ("isDynamic", "boolean", False), ("params", "array<string>", []), ("isGroupLayout", "boolean", False), ("layoutFile", "string", None)],
    "component": [("props", "array<string>", []), ("hasState", "boolean", False), ("isPage", "boolean", False), ("jsxChildCount", "int", 0)],
    "api_route": [("method", "string", ""), ("route", "string", ""), ("isNextApiRoute", "boolean", False)],
    "trpc_procedure": [("procedureType", ("query", "mutation", "subscription"), "query"), ("routerName", "string", ""), ("procedureName", "string", ""), ("hasInput", "boolean", False), ("hasOutput", "boolean", False), ("isRouter", "boolean", None)],
    "tsrpc_service": [("servicePath", "string", ""), ("transport", ("http", "ws"), "http"), ("reqTypeName", "string", None), ("resTypeName", "string", None), ("hasCustomError", "boolean", False), ("isMessage", "boolean", None)],
    "tsrpc_api": [("apiPath", "string", ""), ("transport", ("http", "ws"), "http"), ("reqTypeName", "string", None), ("resTypeName", "string", None), ("hasCustomError", "boolean", False), ("protocolFilePath", "string", None)],
    "tsrpc_msg": [("msgName", "string", ""), ("msgTypeName", "string", ""), ("transport", ("http", "ws"), "http"), ("hasImplementation", "boolean", False)],
    "express_route": [("method", "string", ""), ("route", "string", ""), ("middleware", "array<string>", [])],
    "handler": [("functionName", "string", ""), ("routeId", "string", None), ("isSynthetic", "boolean", None)],
    "service": [("className", "string", None), ("methodName", "string", ""), ("isSynthetic", "boolean", None), ("importedFrom", "string", None), ("discoveredBySymbolResolver", "boolean", None)],
    "db_model": [("tableName", "string", ""), ("fieldCount", "int", 0)],
    "module": [("childCount", "int", 0), ("childTypes", "array<string>", []), ("routePrefix", "string", None), ("dirPath", "string", None)],
    "kotlin_class": [("className", "string", ""), ("kind", ("regular", "data", "sealed", "abstract", "enum"), "regular"), ("packageName", "string", ""), ("annotations", "array<string>", []), ("superClass", "string", None), ("interfaces", "array<string>", [])],
    "kotlin_interface": [("interfaceName", "string", ""), ("packageName", "string", ""), ("annotations", "array<string>", []), ("superInterfaces", "array<string>", [])],
    "kotlin_object": [("objectName", "string", ""), ("packageName", "string", ""), ("isCompanion", "boolean", False), ("annotations", "array<string>", [])],
    "kotlin_function": [("functionName", "string", ""), ("packageName", "string", ""), ("isTopLevel", "boolean", False), ("isExtension", "boolean", False), ("receiverType", "string", None), ("returnType", "string", None), ("annotations", "array<string>", [])],
    "kotlin_route": [("method", "string", ""), ("path", "string", ""), ("framework", ("spring", "ktor"), "spring"), ("annotations", "array<string>", [])],
    "test_suite": [_FRAMEWORK, ("kind", ("file", "describe", "class", "spec"), "file")],
    "test_case": [_FRAMEWORK, ("isParameterized", "boolean", False), ("parameterSource", "string", None), ("disabled", "boolean", False)],
    "test_fixture": [_FRAMEWORK, ("lifecycle", ("before_each", "after_each", "before_all", "after_all", "custom"), "before_each")],
}
EDGE_METADATA = {
    "renders": [("jsxLine", "int", None)], "navigates_to": [("method", "string", "")],
    "calls_api": [("method", "string", None), ("callType", ("fetch", "axios", "trpc", "tsrpc"), "fetch"), ("url", "string", None), ("callLine", "int", 0), ("matchedFrom", "string", None)],
    "handles": [("handlerName", "string", None)], "calls_service": [("serviceName", "string", None), ("callLine", "int", None)],
    "queries_db": [("operation", "string", None), ("callLine", "int", None), ("repository", "string", None)],
    "db_relation": [("relationType", ("one_to_many", "one_to_one", "many_to_one", "many_to_many"), "one_to_many"), ("fieldName", "string", None), ("relationName", "string", "")],
    "contains": [("reason", "string", None), ("routerName", "string", None), ("procedureName", "string", None)],
    "kotlin_inherits": [("superClass", "string", ""), ("line", "int", 0)], "kotlin_implements": [("interfaceName", "string", ""), ("line", "int", 0)], "kotlin_uses": [("usageType", "string", ""), ("line", "int", 0)],
    "sends_msg": [("msgName", "string", ""), ("callLine", "int", 0)], "listens_msg": [("msgName", "string", ""), ("callLine", "int", 0)],
    "imports": [("importPath", "string", ""), ("importedNames", "array<string>", []), ("isTypeOnly", "boolean", False)],
    "data_flows_to": [("typeName", "string", ""), ("transferMethod", ("prisma_result", "return_type", "hook_data"), "prisma_result")],
    "tests": [("relation", "string", "contains")], "covers": [("evidence", ("direct_import", "route_literal"), "direct_import")], "uses_fixture": [("usage", "string", "lifecycle")],
}
