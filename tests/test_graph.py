"""Operators on small graphs written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.graph import of_rows
from stratagraph.operators import coverage, dedup, detect, joins, lookup, match, stats, traverse


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def n(id_, kind, **more):
    return {"id": id_, "type": kind} | more


def e(source, kind, target, **more):
    return {"source": source, "type": kind, "target": target} | more


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [n("p1", "page"), n("p2", "page"), n("c1", "component"), n("r1", "api_route", metadata='{"route":"/api/x","method":"GET"}'), n("h1", "handler"), n("s1", "service", name="Orders", file_path="src/orders.ts"), n("s2", "service"), n("m1", "db_model", name="Order")]
    edges = [e("p1", "renders", "c1"), e("c1", "calls_api", "r1"), e("p2", "calls_api", "r1"), e("r1", "handles", "h1"), e("h1", "calls_service", "s1"), e("s2", "calls_service", "s1"), e("s1", "calls_service", "s2"), e("s1", "queries_db", "m1"), e("s1", "tests", "m1")]
    return of_rows(spark, nodes, edges).cache()


def test_sanitize_counts_in_order(spark):
    g = of_rows(spark, [n("a", "page"), n("b", "page")], [e("a", "renders", "b"), e("a", "renders", "b"), e("a", "calls_api", "b"), e("a", "renders", "a"), e("x", "renders", "x"), e("a", "renders", "z")])
    got = dedup.sanitize(g)
    assert got.removed.first().asDict() == {"self_loop": 2, "dangling": 1, "duplicate": 1, "kept": 2}
    assert sorted((r.source, r.type, r.target) for r in got.graph.edges.collect()) == [("a", "calls_api", "b"), ("a", "renders", "b")]


def test_sanitize_does_not_depend_on_partitions(spark):
    edges = [e("a", "renders", "b", confidence="certain" if i == 3 else "inferred", ord=(0, 0, 0, (i * 7) % 10)) for i in range(10)]
    nodes = [n("a", "page"), n("b", "page")]
    kept = {dedup.sanitized_edges(of_rows(spark, nodes, rows)).first()["confidence"] for rows in (edges, edges[::-1])}
    assert kept == {"inferred"}  # ordinal 0 is the first row, whatever the order of rows


def test_empty_graph(spark):
    g = of_rows(spark, [], [])
    assert dedup.sanitize(g).removed.first()["kept"] == 0
    assert detect.consistency(g).count() == 0
    assert traverse.affected_pages(g, "x").count() == 0
    assert traverse.strong_components(g.edges).count() == 0
    assert coverage.project(g).summary.first()["suites"] == 0


def test_keep_last_has_the_first_place(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "id string, v int, ord int")
    assert sorted(map(tuple, dedup.keep_last(rows, "id").collect())) == [("a", 2, 5), ("b", 3, 1)]
    assert sorted(map(tuple, dedup.keep_first(rows, "id").collect())) == [("a", 1, 5), ("b", 3, 1)]


def test_coverage_merge_upgrades_only_to_certain(spark):
    a = of_rows(spark, [], [e("c", "covers", "t", confidence="inferred", metadata='{"evidence":"direct_import"}')]).edges
    b = of_rows(spark, [], [e("c", "covers", "t", confidence="certain", metadata="{}")]).edges
    c = of_rows(spark, [], [e("c", "covers", "t", confidence="inferred", metadata='{"evidence":"route_literal"}')]).edges
    assert dedup.merge_coverage(a, b).first()["confidence"] == "certain"
    assert "direct_import" in dedup.merge_coverage(a, c).first()["metadata"]


def test_rejected_edges(spark):
    g = of_rows(spark, [n("a", "page"), n("b", "page")], [e("x", "renders", "y"), e("a", "renders", "y"), e("a", "renders", "b", metadata="nonsense"), e("b", "renders", "a")])
    assert sorted(r.reason for r in dedup.rejected_edges(g).collect()) == ["invalid_metadata", "missing_source", "missing_target"]


def test_neighbours_keep_parallel_edges(chain):
    assert ids(joins.downstream(chain, "s1")) == ["m1", "m1", "s2"]
    assert ids(joins.upstream(chain, "s1", ("calls_service",))) == ["h1", "s2"]
    assert joins.upstream(chain, "s1", ()).count() == 0


def test_affected_pages_do_not_follow_renders(chain):
    assert ids(traverse.affected_pages(chain, "m1")) == ["p2"]
    assert ids(traverse.affected_pages(chain, "m1", 2)) == []
    assert ids(traverse.affected_pages(chain, "m1", 3)) == ["p2"]


def test_parent_routes_end_on_cycles(chain):
    assert sorted(map(tuple, traverse.parent_routes(chain, chain.nodes.where("id in ('s1', 's2', 'r1')").select("id")).collect())) == [("r1", "r1"), ("s1", "r1"), ("s2", "r1")]


def test_model_flows(chain):
    got = sorted((r.transfer_method, r.from_id, r.to_id) for r in traverse.model_flows(chain).collect())
    assert got == [("hook_data", "r1", "c1"), ("prisma_result", "m1", "s1"), ("return_type", "h1", "r1")]
    assert traverse.model_totals(chain).first().asDict() == {"model_id": "m1", "total_routes": 1, "total_components": 1}


def test_linear_trace_shares_one_budget(spark):
    g = of_rows(spark, [n(f"n{i:03}", "handler") for i in range(130)], [e(f"n{i:03}", "calls_service", f"n{i + 1:03}") for i in range(129)])
    got = traverse.linear_traces(g, g.nodes.where("id = 'n010'").select("id"), steps=16).orderBy("index").collect()
    assert [r.node_id for r in got] == [f"n{i:03}" for i in range(16)]
    assert got[0]["edge_from_prev"] is None and got[5]["edge_from_prev"] == "calls_service"


def test_subtree_is_claimed_depth_first(spark):
    g = of_rows(spark, [n(x, "component") for x in "abcd"], [e("a", "renders", "b", ord=(0, 0, 0, 1)), e("a", "renders", "c", ord=(0, 0, 0, 2)), e("b", "renders", "c", ord=(0, 0, 0, 3)), e("c", "renders", "a", ord=(0, 0, 0, 4))])
    rows = [(r.id, r.parent_id, r.depth) for r in traverse.subtree(g, "a", "renders", 9).orderBy("dfs_ord").collect()]
    assert rows == [("a", None, 0), ("b", "a", 1), ("c", "b", 2)]
    assert traverse.subtree(g, "a", "renders", float("nan")).count() == 1
    assert traverse.subtree(g, "zzz", "renders", 3).count() == 0


def walked(edges, root, depth):
    """A depth-first walk, step by step; edges in order."""
    stack, rows = [(root, None, 0)], {}
    while stack:
        id_, parent, at = stack.pop()
        if id_ not in rows:
            rows[id_] = (parent, at, len(rows))
            stack += [(c, id_, at + 1) for s, c in reversed(edges) if s == id_ and at < depth]
    return {(root, k, *v) for k, v in rows.items()}


@pytest.mark.parametrize("seed", range(2))
def test_subtrees_equal_the_walk(spark, seed):
    """Cycles, repeated edges and loops; a node claimed at the last depth blocks shorter ways through it."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(10)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(22)]
    g = of_rows(spark, [n(x, "component") for x in names], [e(a, "renders", b, ord=(0, 0, 0, i)) for i, (a, b) in enumerate(edges)] + [e("n1", "renders", "gone")])
    for depth in (3, 1000):
        got = {tuple(r) for r in traverse.subtrees(g.nodes, g.edges, g.nodes, depth).select("root", "id", "parent_id", "depth", "dfs_ord").collect()}
        assert got == set().union(*(walked(edges, x, depth) for x in names))


@pytest.mark.parametrize("value", ["Infinity", 1e9, -5, 2.5, True, [], "x"])
def test_depth_is_checked(value):
    with pytest.raises(ValueError):
        lookup.valid_depth(value, 3)
    assert lookup.valid_depth(None, 3) == 3 and lookup.valid_depth("7", 3) == 7


def test_strong_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a")], "source string, target string")
    assert sorted(map(tuple, traverse.strong_components(edges).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]


def test_search_and_cascade(chain):
    assert ids(lookup.search(chain, " ORDER ")) == ["m1", "s1"]
    assert lookup.search(chain, "  ").count() == 8
    assert lookup.visible_ids(chain, "") is None
    assert lookup.find_any(chain, "/api/x").first()["id"] == "r1"
    assert lookup.find_any(chain, "src/orders.ts").first()["id"] == "s1"
    with pytest.raises(ValueError):
        lookup.nodes_by_type(chain, "nonsense")
    assert lookup.nodes_by_type(chain).count() == 0


def test_facets_count_all_edges(chain):
    shown = lookup.facet_filter(chain, edge_types=("renders",), hide_isolated=True)
    assert shown.nodes.count() == 8 and shown.edges.count() == 1


def test_typed_metadata_defaults(spark):
    g = of_rows(spark, [n("t", "test_case", metadata='{"framework":"nope","disabled":true}'), n("b", "test_case", metadata="broken")], [])
    rows = {r.id: r for r in lookup.typed_nodes(g, "test_case").collect()}
    assert (rows["t"].framework, rows["t"].disabled, rows["b"].framework, rows["b"].isParameterized) == ("vitest", True, "vitest", False)


def test_detectors(spark):
    nodes = [n("component:f:A", "component"), n("r1", "api_route", metadata='{"method":"GET,POST","route":"/a"}'), n("r2", "api_route", metadata='{"method":"ALL"}'), n("s", "service"), n("mod", "module"), n("lone", "handler")]
    edges = [e("component:f:A", "calls_api", "r1", metadata='{"method":"delete","callLine":4}'), e("component:f:A", "calls_api", "r2", metadata='{"method":"PUT"}'), e("component:f:A", "calls_api", "gone")]
    g = of_rows(spark, nodes, edges)
    assert [r.related_edges for r in detect.dead_calls(g).collect()] == [["component:f:A--calls_api--gone"]]
    assert [r.related_nodes for r in detect.method_mismatches(g).collect()] == [["component:f:A", "r1"]]
    assert sorted(r.related_nodes[0] for r in detect.orphans(g).collect()) == ["lone", "s"]
    assert [r.related_nodes[0] for r in detect.dead_services(g).collect()] == ["s"]
    assert detect.unused_routes(g).count() == 0


def test_a_failing_detector_does_not_hide_others(spark):
    def broken(graph):
        return detect.dead_services(graph).withColumn("description", F.raise_error(F.lit("broken")))

    lonely = of_rows(spark, [n("s", "service"), n("c", "component")], [])
    issues, failed = detect.run_detectors(lonely, {"bad": broken, "good": detect.dead_components})
    assert list(failed) == ["bad"] and [r.type for r in issues.collect()] == ["dead_component"]


def test_import_cycle_issue(spark):
    g = of_rows(spark, [n("module:a.ts:a", "module"), n("module:b.ts:b", "module")], [e("module:a.ts:a", "imports", "module:b.ts:b"), e("module:b.ts:b", "imports", "module:a.ts:a")])
    assert detect.import_cycles(g).first()["id"] == "circular-module:a.ts:a-module:b.ts:b"


def test_issue_order(spark):
    rows = [("i1", "info", "a.ts"), ("i2", "critical", "z.ts"), ("i3", "critical", "B.ts"), ("i4", "critical", "a.ts")]
    g = of_rows(spark, [n(f"x:{f}:y", "service", file_path=f, name=i) for i, s, f in rows], [])
    base = detect.dead_services(g)
    severities = {i: s for i, s, _ in rows}
    issues = base.withColumn("severity", F.create_map(*[F.lit(x) for p in severities.items() for x in p])[F.regexp_extract("description", r"(i\d)$", 1)])
    assert [r.locations[0].file for r in detect.ranked_issues(issues).collect()] == ["a.ts", "B.ts", "z.ts", "a.ts"]
    assert detect.issue_summary(issues).first().asDict() == {"total": 4, "critical": 3, "warning": 0, "info": 1}


def test_url_tiers(spark):
    calls = spark.createDataFrame([("/api/a?x",), ("/base/api/a/",), ("zzz/b",), ("/none",), ("",)], "url string")
    routes = spark.createDataFrame([("/api/a", "ra", 1), ("/x/b", "rb", 2), ("/y/b", "rc", 3), ("/a", "rd", 0)], "route string, target string, ord int")
    got = {r.url: (r.tier, r.target) for r in match.match_urls(calls, routes).collect()}
    assert got == {"/api/a?x": (0, "ra"), "/base/api/a/": (2, "ra"), "zzz/b": (3, "rb")}


def test_procedure_and_service_tiers(spark):
    procedures = spark.createDataFrame([("user.get", "user", "get", "p1", 1), ("x", "post", "list", "p2", 2)], "node_name string, router string, procedure string, target string, ord int")
    calls = spark.createDataFrame([("user.get",), ("post.list",), ("post",)], "name string")
    assert {r["name"]: r.target for r in match.match_procedures(calls, procedures).collect()} == {"user.get": "p1", "post.list": "p2"}
    services = spark.createDataFrame([("user/Login", "Login", "s1", 1), ("x/y", "ApiPing", "s2", 2)], "path string, node_name string, target string, ord int")
    calls = spark.createDataFrame([("/user/login/",), ("other/LOGIN",), ("ping",), ("no",)], "path string")
    assert {r.path: r.tier for r in match.match_services(calls, services).collect()} == {"/user/login/": 0, "other/LOGIN": 1, "ping": 2}


def test_path_aliases():
    a = match.PathAliases({"@/*": ["src/*"], "@lib": ["lib/index.ts"]})
    assert a.resolve("@/a/b") == ["src/a/b"] and a.resolve("@lib") == ["lib/index.ts"] and a.resolve("react") == []
    assert match.import_candidates("a/b/c.ts", "../d")[:2] == ["a/d", "a/d.ts"]


def test_views(chain, spark):
    assert ids(traverse.request_view(chain).nodes) == ["c1", "h1", "m1", "p1", "p2", "r1", "s1", "s2"]
    assert ids(traverse.data_view(chain).nodes) == ["m1", "s1"]
    assert ids(traverse.focus(chain, "r1").nodes) == ["c1", "h1", "p2", "r1"]
    assert traverse.focus(chain, "unknown").nodes.count() == 8
    g = of_rows(spark, [n("a", "page", file_path="frontend/src/a/x.ts"), n("b", "page", file_path="frontend/src/b/y.ts"), n("c", "page", file_path="top.ts")], [e("a", "renders", "b"), e("b", "renders", "b")])
    modules, edges = traverse.module_overview(g)
    assert {r.scope: r.child_count for r in modules.collect()} == {"frontend": 2, "frontend/a": 0, "frontend/b": 0, "project": 0}
    assert sorted(map(tuple, edges.collect())) == [("frontend", "frontend/a", "contains"), ("frontend", "frontend/b", "contains"), ("frontend/a", "frontend/b", "renders")]


def test_test_views(spark):
    f = lambda x, **m: {"metadata": __import__("json").dumps({"framework": x} | m)}
    nodes = [n("S", "test_suite", file_path="t.ts", **f("jest")), n("C1", "test_case", file_path="t.ts", **f("jest")), n("C2", "test_case", file_path="t.ts", **f("jest", disabled=True)), n("F", "test_fixture", file_path="t.ts", **f("jest")), n("svc", "service", name="Pay"), n("other", "service")]
    g = of_rows(spark, nodes, [e("S", "tests", "C1"), e("S", "tests", "C2"), e("C1", "covers", "svc")])
    view = coverage.project(g, target="pay")
    assert view.summary.first().asDict() == {"suites": 1, "cases": 1, "fixtures": 1, "covered_targets": 1, "uncovered_targets": 0}
    assert coverage.project(g).summary.first()["uncovered_targets"] == 1
    assert {r.framework: r.n for r in coverage.project(g).by_framework.collect()}["jest"] == 2
    assert coverage.suite_groups(g, status="disabled").first()["cases"] == ["C2"]
    assert coverage.suite_groups(g, framework="vitest").count() == 0
    assert ids(traverse.test_graph(g, "C2").edges, "type") == ["tests", "tests"]


def test_unmatched_and_literals(spark):
    results = spark.createDataFrame([("s", "a > b"), ("s", "b"), ("a", "b"), ("s", "zz")], "suite string, name string")
    cases = spark.createDataFrame([("a > b",)], "name string")
    assert [r["name"] for r in joins.unmatched_cases(results, cases).collect()] == ["zz"]
    texts = spark.createDataFrame([("t1", "get('/api/a'); `/api/b`"), ("t2", "/api/a")], "source string, text string")
    routes = spark.createDataFrame([("/api/a", "ra"), ("/api/b", "rb")], "route string, target string")
    assert sorted(map(tuple, joins.literal_links(texts, routes).collect())) == [("t1", "ra"), ("t1", "rb")]


def test_unique_candidates(spark):
    wanted = spark.createDataFrame([("w1", 1), ("w2", 2), ("w3", 3)], "w string, k int")
    candidates = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "k int, target string")
    assert list(map(tuple, joins.unique_candidates(wanted, candidates, ["k"], ["w"]).collect())) == [("w1", "x")]


def test_digest_is_stable(chain, spark):
    from stratagraph.graph import Graph

    shuffled = Graph(chain.nodes.repartition(7, "name"), chain.edges.repartition(5))
    assert stats.graph_digest(chain) == stats.graph_digest(shuffled)
    assert stats.graph_digest(chain) != stats.graph_digest(Graph(chain.nodes.limit(3), chain.edges))


def test_severity_counts_are_filled(spark):
    rows = spark.createDataFrame([("info",), ("info",)], "severity string")
    assert {r.severity: r.n for r in stats.severity_counts(rows).collect()} == {"critical": 0, "warning": 0, "info": 2}


def test_kotlin_links(spark):
    nodes = [n("r", "kotlin_route", name="get", file_path="a.kt"), n("f", "kotlin_function", name="get", file_path="a.kt"), n("c", "kotlin_class", file_path="a.kt", metadata='{"annotations":["Service"]}'), n("k", "kotlin_class", file_path="a.kt", metadata='{"annotations":["Repository"]}'), n("m", "db_model", file_path="a.kt")]
    got = sorted(map(tuple, joins.kotlin_links(of_rows(spark, nodes, [])).collect()))
    assert got == [("f", "c", "calls_service"), ("k", "m", "queries_db"), ("r", "f", "handles")]


def test_literal_links_see_a_route_after_odd_quotes(spark):
    lines = ["fetch('', '/api/x')", "// don't call '/api/x'", "a='b',c='/api/x'", 'say("it\'s", "/api/x")', "\"/api/x'", "/api/x"]
    texts = spark.createDataFrame(list(enumerate(lines)), "source int, text string")
    routes = spark.createDataFrame([("/api/x", "r")], "route string, target string")
    assert ids(joins.literal_links(texts, routes), "source") == [0, 1, 2, 3]


def walk(edges, nodes, root, steps):
    """The main path through a root in plain Python: upstream, then downstream, by the first edge to a node not yet on it."""
    first = {}
    for e in edges:
        if e.source in nodes and e.target in nodes and e.type in traverse.LINK_EDGES:
            key = (e.source, e.target)
            first[key] = min(first.get(key, e.ord), e.ord)
    path, seen, left = [root], {root}, steps - 1
    for up in (True, False):
        at = root
        while left:
            options = [(o, a if up else b) for (a, b), o in first.items() if (b if up else a) == at and (a if up else b) not in seen]
            if not options:
                break
            at = min(options)[1]
            seen.add(at)
            path.insert(0, at) if up else path.append(at)
            left -= 1
    return path


def test_linear_trace_of_the_whole_graph(spark):
    """All link types, upstream and downstream, over a cut of the derived graph."""
    import random

    rng, kinds = random.Random(3), sorted(traverse.LINK_EDGES)
    ids = [f"n{i:02}" for i in range(30)]
    edges = [e(rng.choice(ids), rng.choice(kinds), rng.choice([*ids, "gone"]), ord=(0, 0, 0, k)) for k in range(70)]
    g = of_rows(spark, [n(i, "handler") for i in ids], edges)
    rows, known = g.edges.collect(), {r.id for r in g.nodes.collect()}
    got = {}
    for r in traverse.linear_traces(g, g.nodes.select("id"), steps=9).orderBy("root", "index").collect():
        got.setdefault(r.root, []).append(r.node_id)
    assert got == {i: walk(rows, known, i, 9) for i in ids} and max(map(len, got.values())) > 6


def test_operations_of_a_query_edge(spark):
    """The last of a pair's different operations, in the order they first appear, and all of them."""
    from stratagraph.plans.link import query_operations

    rows = [("h", "m", 0, "create"), ("h", "m", 1, "findMany"), ("h", "m", 2, "create"), ("h", "o", 3, "count")]
    got = sorted(map(tuple, query_operations(spark.createDataFrame(rows, "node_id string, target string, at int, operation string")).collect()))
    assert got == [("h", "m", "findMany", ["create", "findMany"]), ("h", "o", "count", ["count"])]


def test_call_chains_over_imports(spark):
    from stratagraph.operators.match import PathAliases
    from stratagraph.plans.link import call_chains

    facts = [
        ("a.ts", "scope", "start", None, None, "helper(x); go(1)"), ("a.ts", "scope", "helper", None, None, "return 1"), ("a.ts", "import", "go", "./lib/b", "run", None),
        ("lib/b.ts", "scope", "run", None, None, "deep()\n obj.other()"), ("lib/b.ts", "scope", "other", None, None, ""), ("lib/b.ts", "import", "deep", "@/c", "default", None), ("src/c.ts", "scope", "deep", None, None, "start()"),
    ]
    df = spark.createDataFrame([(*f, 1, 0) for f in facts], "path string, kind string, name string, source string, target string, value string, line int, emit long")
    starts = spark.createDataFrame([("a.ts#start",)], "id string")
    reached = lambda depth, aliases: {r[1] if len(r) > 2 else r[0] for r in call_chains(df, starts, depth, aliases).collect()} - {"a.ts#start"}
    aliases = PathAliases({"@/*": ["src/*"]})
    assert reached(1, aliases) == {"a.ts#helper", "lib/b.ts#run"}
    assert reached(5, aliases) == {"a.ts#helper", "lib/b.ts#run", "src/c.ts#deep"}
    assert reached(5, None) == {"a.ts#helper", "lib/b.ts#run"}


def test_path_aliases_of_a_tsconfig(tmp_path):
    from stratagraph.sources.files import path_aliases

    assert not path_aliases(str(tmp_path)).any
    (tmp_path / "tsconfig.json").write_text('{ // note\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "lib/*"], "@one": ["x/one.ts",],}, /* end */ }, }')
    aliases = path_aliases(str(tmp_path))
    assert "src/a/b.ts" in aliases.files("@/a/b", "p.ts") and "lib/a/b/index.tsx" in aliases.files("@/a/b", "p.ts") and "x/one.ts" in aliases.files("@one", "p.ts")
    assert aliases.files("./q", "d/p.ts")[1] == "d/q.ts" and aliases.files("react", "p.ts") == []


def test_rules_in_one_pass(spark):
    """The rules together find what they find one by one."""
    import random

    rng = random.Random(12)
    kinds = ["page", "component", "api_route", "trpc_procedure", "express_route", "service", "module", "handler"]
    nodes = [n(f"{k}:f{i % 4}:{i}", k, metadata=rng.choice(["{}", '{"method":"GET, POST"}', '{"method":"all"}', '{"isRouter":true}', '{"method":""}', "broken"])) for i, k in enumerate(rng.choice(kinds) for _ in range(60))]
    ids = [x["id"] for x in nodes] + ["api_route:gone:1", "x"]
    types = ["calls_api", "renders", "calls_service", "handles", "tests"]
    edges = [e(rng.choice(ids), rng.choice(types), rng.choice(ids[20:]), metadata=rng.choice(["{}", '{"method":"put","callLine":3}', '{"method":"get"}', '{"method":""}']), ord=(0, 0, 0, i)) for i in range(200)]
    nodes += [n("api_route:r", "api_route", metadata='{"method":"GET, POST"}'), n("trpc_procedure:p", "trpc_procedure", metadata='{"procedureName":"list"}')]
    edges += [e("page:a:1", "calls_api", "api_route:r", metadata='{"method":"put","callLine":3}')] + [e("page:a:1", "calls_api", f"gone:{u}", metadata=f'{{"callType":"trpc","url":"{u}"}}') for u in ("x.list", "x.other")]
    g = of_rows(spark, nodes, edges)
    one_by_one = None
    for rule in (detect.dead_calls, detect.unused_routes, detect.orphans, detect.method_mismatches, detect.missing_procedures, detect.dead_routes, detect.dead_components, detect.dead_services, detect.import_cycles):
        one_by_one = rule(g) if one_by_one is None else one_by_one.unionByName(rule(g))
    rows = lambda df: sorted(repr(r) for r in df.select(*one_by_one.columns).collect())
    assert rows(detect.consistency(g)) == rows(one_by_one) and one_by_one.select("type").distinct().count() == 7
