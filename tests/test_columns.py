"""Scalar functions over Columns."""

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import columns as C


def value(spark, expr, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} {'int' if isinstance(a, int) else 'string'}" for i, a in enumerate(args)))
    return row.select(expr(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, args, want",
    [
        (C.node_id, ("page", "a/b.ts", "x:y"), "page:a/b.ts:x:y"),
        (C.normalize_url, ("",), "/"),
        (C.normalize_url, (None,), "/"),
        (C.normalize_url, ("a//",), "/a/"),
        (C.normalize_url, ("/a/?q=/b/",), "/a"),
        (C.last_segment, ("/a/b//",), "b"),
        (C.last_segment, ("//",), None),
        (C.without_api, ("/api/x",), "/x"),
        (C.without_base, ("/app/api/x",), "/api/x"),
        (C.without_base, ("/api/x",), None),
        (C.slashes, ("a\\b",), "a/b"),
        (C.capitalized, ("order line",), "Order line"),
        (C.pascal_case, ("order-line_2 item",), "OrderLine2Item"),
        (C.line_of, ("a\nb\nc", 3), 2),
        (C.line_of, ("a\nb\nc", 0), 1),
        (C.join_route, ("/a/", "/b/"), "/a/b"),
        (C.join_route, (None, None), "/"),
        (C.app_route, ("src/app/page.tsx",), "/"),
        (C.app_route, ("app/(g)/x/@side/[id]/page.tsx",), "/x/side/[id]"),
        (C.pages_route, ("pages/index.tsx",), "/"),
        (C.pages_route, ("pages/a/[...rest].tsx",), "/a/[...rest]"),
        (C.route_params, ("/a/[id]/[...rest]/[[...more]]",), ["id", "rest", "more"]),
        (C.is_test_path, ("src/__tests__/a.ts",), True),
        (C.is_test_path, ("src/A.SPEC.ts",), True),
        (C.is_test_path, ("src/contest.ts",), False),
        (C.directive, ("\n 'use client'\n",), "client"),
        (C.directive, ("// 'use client'",), None),
        (C.has_auth, ("x = await getSession (req)",), True),
        (C.has_auth, ("import { getSession } from 'x'",), False),
        (C.has_auth, ("myauth(1)",), False),
        (C.has_auth, ("protectedProcedure.query",), True),
        (C.is_public_route, ("/api/health/db",), True),
        (C.is_public_route, ("/api/booking",), False),
        (C.is_public_route, ("/api/book",), True),
        (C.trace_layer, ("kotlin_route",), "api"),
        (C.trace_layer, ("nonsense",), "other"),
        (C.severity_rank, ("warning",), 2),
        (C.duration_ms, ("1.5",), 1500.0),
        (C.duration_ms, ("-2",), 0.0),
        (C.duration_ms, ("soon",), 0.0),
    ],
)
def test_function(spark, function, args, want):
    assert value(spark, function, *args) == want


def test_id_parts(spark):
    assert tuple(value(spark, C.node_id_parts, "page:a/b.ts:x:y")) == ("page", "a/b.ts", "x:y")
    assert value(spark, C.node_id_parts, "page:a") is None
    assert tuple(value(spark, C.edge_id_parts, "a--b--renders--c--d")) == ("a", "b", "renders--c--d")
    assert value(spark, C.edge_id_parts, "a-b") is None


@pytest.mark.parametrize("path, want", [("top.ts", ("project", "project")), ("a/b.ts", ("a", "a")), ("a/b/c.ts", ("a", "a/b")), ("frontend/src/x/y.ts", ("frontend", "frontend/x")), ("backend\\src\\x\\y.ts", ("backend", "backend/x"))])
def test_directory_scope(spark, path, want):
    assert tuple(value(spark, C.directory_scope, path)) == want
