"""Steps that must not grow faster than their input: how work is dealt out, and what is sent to the driver."""

import pytest
from pyspark.sql import functions as F

from stratagraph.extract import registry
from stratagraph.plans import link


def test_many_short_files_are_dealt_out(spark):
    """One split with thousands of files that compress to nothing is read by several tasks."""
    n = 4 * registry.LEAST_FILES
    files = spark.range(n, numPartitions=1).select(F.concat(F.lit("lib/f"), "id", F.lit(".ts")).alias("path"), F.lit("export function f() {}\n").alias("text"), F.col("id").alias("ord"))
    _, _, facts = registry.extract(files, {})
    assert facts.where("kind = 'scope'").count() == n
    assert facts.select(F.input_file_name().alias("f")).distinct().count() == 4


def test_a_manifest_is_asked_once_a_project():
    """Which extractors a project calls for doesn't depend on its files, so the work a file takes doesn't either."""
    asked = [0]

    class Manifest(dict):
        def get(self, *key):
            asked[0] += 1
            return super().get(*key)

    meta, found, own = Manifest(frontend="next"), registry.Registry(), []
    for i in range(50):
        own.append([e.parser for _, _, e in found.run(f"app/p{i}/page.tsx", "export default function Page() {}\n", meta)])
    assert asked[0] <= len(found.extractors) and own == [["next_app", "api_calls", "react"]] * 50
    meta["frontend"] = "none"
    found.register("late", lambda p, t, m: True, lambda src, m: registry.Out(src, "late"))
    assert [e.parser for _, _, e in found.run("app/p/page.tsx", "", meta)] == ["api_calls", "react", "late"]


def test_the_word_import_costs_no_more_than_its_text():
    """Once cubic: a long run of blanks after the word, without any quote."""
    import time

    from stratagraph.extract.code import Source

    began = time.perf_counter()
    source = Source("a.ts", "import x" + " " * 40_000 + "(\nimport type { A, b as c } from './a'\nimport d, * as e from \"./d\"\nimport './s'\n")
    assert len(source.imports()) == 1 or source.imports()[-1]["path"] == "./s"
    assert Source("b.ts", "import" + " " * 40_000 + "x;").imports() == []
    assert time.perf_counter() - began < 2


def test_extracted_rows_are_not_broadcast_unmeasured(spark, tmp_path):
    """The planner's guess of what a Python function returns must not decide that a side goes through the driver."""
    files = spark.createDataFrame([(f"lib/f{i}.ts", f"import {{ g{i} }} from './g{i}'\nexport function f{i}() {{ g{i}() }}\n", i) for i in range(20)], "path string, text string, ord long")
    files.write.parquet(str(tmp_path / "files"))
    edges = link.call_edges(registry.extract(spark.read.parquet(str(tmp_path / "files")), {})[2])
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_pairs_of_a_seed_share_its_walk(spark):
    """A seed with many steps and many goals: the walk holds a row for each step, not one for each step and goal."""
    from stratagraph.operators import reachability

    steps = [("s", f"m{i}") for i in range(60)] + [(f"m{i}", f"g{j}") for i in range(60) for j in range(60) if (i + j) % 2]
    edges = spark.createDataFrame([*steps, ("g1", "dead"), ("m1", "dead")], "source string, target string")
    goals = spark.createDataFrame([(f"g{j}",) for j in range(60)] + [("far",)], "id string")
    pairs = spark.createDataFrame([("s", f"g{j}") for j in range(60)] + [("s", "far"), ("m1", "g1"), ("m1", "g2"), ("far", "far")], "seed string, id string")
    index = reachability.build(edges, goals)
    most, real = [0], reachability.cut

    def counted(df):
        out = real(df)
        most[0] = max(most[0], out.count())
        return out

    reachability.cut = counted
    try:
        got = {tuple(r) for r in reachability.reached_pairs(index, pairs).collect()}
    finally:
        reachability.cut = real
    assert got == {("s", f"g{j}") for j in range(60)} | {("m1", "g2"), ("far", "far")}
    assert most[0] <= 130


def test_names_go_up_stars_without_all_pairs_of_files(spark):
    """A chain and a circle of barrels that one file ends: a row for each file and name, whatever stars connect."""
    from stratagraph.plans import exports

    n = 12
    stars = [(f"b{i:02}", f"b{i + 1:02}") for i in range(n)] + [(f"b{n:02}", "end"), (f"b{n:02}", "b10"), ("b00", "near"), ("near", "last")]
    defined = [("end", "f"), ("end", "default"), ("last", "g"), ("end", "g"), ("b05", "h"), ("end", "unasked")]
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    asked = [("b00", "f"), ("b00", "g"), ("b01", "g"), ("b00", "h"), ("b11", "h"), ("b00", "default"), ("end", "default")]
    sizes, real = [], exports.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    exports.cut = counted
    try:
        got = exports.resolve(frame(asked, "file string, name string"), frame(defined, "file string, name string"), frame([], "file string, name string, to_file string, to_name string"), frame(stars, "file string, target string"))
        got = {tuple(r) for r in got.collect()}
    finally:
        exports.cut = real
    assert got == {("b00", "f", "end", "f"), ("b00", "g", "last", "g"), ("b01", "g", "end", "g"), ("b00", "h", "b05", "h"), ("end", "default", "end", "default")}
    assert max(sizes) < 50  # 100 and more pairs of files are connected


def test_same_file_link_pairs_all_handlers_of_five_files(spark):
    """n handlers, dealt over five files by their keys: n/5 * (n/5 - 1) pairs in each."""
    from stratagraph.queries import queries

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/supplier.parquet").groupBy((F.col("s_suppkey") % 5).alias("k")).count()
    pairs = n.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    got = queries()["same_file_link"](spark, sf)
    assert got.count() == pairs == got.distinct().count()


def test_spread_pairs_are_the_same(spark):
    from stratagraph.graph import of_rows
    from stratagraph.operators.joins import same_file_links

    g = of_rows(spark, [{"id": f"h{i}", "type": "handler", "file_path": f"f{i % 3}"} for i in range(20)] + [{"id": "s", "type": "service", "file_path": "f1"}], [])
    for right in ("handler", "service"):
        assert sorted(map(tuple, same_file_links(g, "handler", right, spread=4).collect())) == sorted(map(tuple, same_file_links(g, "handler", right).collect()))


def test_commit_reads_the_given_graph_twice(spark, tmp_path):
    """A graph that is dear to derive is read for the counts and for what is written; the digest comes from the written rows."""
    from stratagraph.graph import Graph, of_rows
    from stratagraph.operators.stats import graph_digest
    from stratagraph.sources.snapshots import SnapshotStore

    g = of_rows(spark, [{"id": "a"}, {"id": "b"}], [{"source": "a", "target": "b", "type": "imports"}, {"source": "a", "target": "gone", "type": "imports"}, {"source": "b", "target": "a", "type": "imports", "metadata": "[]"}])
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    report = SnapshotStore(spark, str(tmp_path)).commit(Graph(g.nodes, g.edges.mapInArrow(seen, g.edges.schema)))
    assert (report.attempted_edges, report.written_edges, report.rejected) == (3, 1, {"missing_target": 1, "invalid_metadata": 1})
    assert reads.value == 2 * 3
    snapshot = SnapshotStore(spark, str(tmp_path)).load()
    assert report.digest == graph_digest(snapshot.graph) == graph_digest(Graph(g.nodes, g.edges.where("target = 'b'")))


def test_many_texts_that_share_grams_go_by_runs(spark, tmp_path):
    """Numbers as searched texts: every pair of a number and a name shares grams, few are finds."""
    from stratagraph.graph import of_rows
    from stratagraph.operators.text_index import TextIndex

    names = [f"x{i * 7919 % 100000:05}" for i in range(60)]
    index = TextIndex.build(of_rows(spark, [{"id": n, "name": n, "file_path": f"p/{n[1:]}0{n[1:]}.ts"} for n in names], []), str(tmp_path / "index"))
    asked = sorted({f"{a}{b}" for a in ("00", "01", "79", "x0") for b in range(300)} | {".ts", "P/0", "#12", "zzz"})
    runs, real = [], TextIndex._by_runs
    TextIndex._by_runs = lambda self, queries: runs.append(1) or real(self, queries)
    try:
        got = sorted(map(tuple, index.search_all(spark.createDataFrame([(q,) for q in asked], "query string")).collect()))
    finally:
        TextIndex._by_runs = real
    text = {n: (n, f"p/{n[1:]}0{n[1:]}.ts") for n in names}
    assert got == sorted((q.lower(), n) for q in asked for n in names if any(q.lower() in t for t in text[n]))
    assert runs


def test_extraction_makes_only_the_parts_that_are_used(spark):
    """A query of loops runs no extractor, one of a graph writes no texts of functions; their rows are those of the whole."""
    text = "'use client'\nimport { g } from './g'\nexport function Card(x) {\n  for (const a of x) { await prisma.order.create(a) }\n  fetch('/api/x')\n}\n"
    files = spark.createDataFrame([("ui/Card.tsx", text, 0)], "path string, text string, ord long")
    graph, _, facts = registry.extract(files, {})
    kinds = lambda g, f: (g.nodes.count(), g.edges.count(), sorted(map(tuple, f.collect())))
    whole = kinds(graph, facts)
    assert whole[0] and whole[1] and {r[1] for r in whole[2]} == registry.FACTS
    assert kinds(*registry.extract(files, {}, parts=("graph",))[::2]) == (whole[0], whole[1], [])
    for kind in registry.FACTS:
        assert kinds(*registry.extract(files, {}, parts=(kind,))[::2]) == (0, 0, [r for r in whole[2] if r[1] == kind])


def test_brackets_of_a_text_are_matched_in_one_pass(monkeypatch):
    """Calls within calls: every closing bracket is looked up, not searched for from each opening one."""
    from stratagraph.extract import code

    n, seen, real = 300, [0], code._BRACKET

    class Counted:
        def finditer(self, *args):
            for m in real.finditer(*args):
                seen[0] += 1
                yield m

    monkeypatch.setattr(code, "_BRACKET", Counted())
    text = "f(" * n + "{ ] x" + ")" * (n - 1) + "}" + ")" * n
    for at in range(n):
        assert code.closing(text, 2 * at + 1) == len(text) - 1 - at
    assert code.closing(text, 2 * n) == text.index("}") and code.closing("(]", 0) == 2 and code.closing("x", 0) == 1
    assert seen[0] <= 4 * n + 10


def test_sources_are_masked_only_where_code_is_read(monkeypatch):
    """Directives stand in the first characters, and loops without an awaited call hold no query: neither masks the source.
    A source that several extractors read is masked once."""
    from stratagraph.extract import code

    masked, real = [], code.mask
    monkeypatch.setattr(code, "mask", lambda *a, **k: masked.append(a) or real(*a, **k))
    plain = "'use client'\nexport function f(x) {\n  for (const a of x) { g(a) }\n}\n"
    query = "for (const a of x) {\n  // await prisma.order.never()\n  await prisma.order.create(a)\n}\n"
    rows = lambda text, graph, facts: [(r[0], r[3], r[5]) for r in registry._file_rows(registry.Registry(), "ui/f.tsx", text, 0, {}, graph, facts)]
    assert rows(plain, False, {"directive"}) == [("directive", "client", None)] and rows(plain, False, {"loop"}) == [] and not masked
    assert rows(query, False, {"loop"}) == [("loop", "prisma.order.create", 3)] and len(masked) == 1
    assert {r[0] for r in rows(plain + query, True, registry.FACTS)} == {"directive", "scope", "loop"} and len(masked) == 2


def test_a_short_trace_moves_only_what_it_meets(spark, monkeypatch):
    """A graph much larger than the walk: its nodes aren't numbered and its edges aren't joined to them. Edges that lead
    nowhere, though first, are passed over."""
    from stratagraph.graph import of_rows
    from stratagraph.operators import traverse

    edge = lambda source, type_, target, at: {"source": source, "type": type_, "target": target, "ord": (0, 0, 0, at)}
    nodes = [{"id": f"c{i:03}", "type": "component"} for i in range(300)] + [{"id": i, "type": t} for i, t in (("r", "api_route"), ("h", "handler"), ("s", "service"))]
    edges = [edge(f"c{i:03}", "calls_api", "r", 300 - i) for i in range(300)] + [edge("gone", "calls_api", "r", 0), edge("h", "calls_service", "lost", 0), edge("r", "handles", "h", 1), edge("h", "calls_service", "s", 2)]
    most, real = [0], traverse.cut

    def counted(df):
        out = real(df)
        most[0] = max(most[0], 0 if {"ord"} & set(out.columns) else out.count())  # ord: all steps of nodes whose first one leads nowhere
        return out

    monkeypatch.setattr(traverse, "cut", counted)
    g = of_rows(spark, nodes, edges)
    rows = traverse.linear_traces(g, g.nodes.where("type = 'handler'").select("id")).orderBy("index").collect()
    assert [(r.node_id, r.edge_from_prev) for r in rows] == [("c299", None), ("r", "calls_api"), ("h", "handles"), ("s", "calls_service")]
    assert most[0] <= 8


def test_affected_pages_of_many_need_no_index(spark, monkeypatch):
    """More seeds than fit one number, with a circle, a page above a page, and a bound: as by a walk of each, without an index."""
    from stratagraph.graph import of_rows
    from stratagraph.operators import reachability

    ids = [f"s{i}" for i in range(70)]
    nodes = [{"id": i, "type": "service"} for i in ids] + [{"id": p, "type": "page"} for p in ("p0", "p1", "p2")]
    calls = [(ids[i + 1], ids[i]) for i in range(69)] + [("s3", "s5"), ("p0", "s4"), ("p1", "s66"), ("p1", "gone"), ("p2", "p1")]
    g = of_rows(spark, nodes, [{"source": a, "type": "calls_service", "target": b} for a, b in calls])
    want = set()
    for seed in [*ids, "p1"]:
        ring, seen = {seed}, {seed}
        for _ in range(11):
            ring = {a for a, b in calls if b in ring and not (b[0] == "p")} - seen
            seen |= ring
        want |= {(seed, p) for p in seen if p[0] == "p" and p != seed}
    monkeypatch.setattr(reachability, "build", None)
    seeds = spark.createDataFrame([(i,) for i in (*ids, "p1", "unknown")], "id string")
    assert sorted(map(tuple, reachability.affected_pages_of(g, seeds).collect())) == sorted(want) and len({s for s, _ in want}) > 10


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("limit", [500_000, 2, 0])
def test_commit_does_not_shuffle_whole_edges(spark, tmp_path, monkeypatch, limit):
    """Edges with large metadata; a type with more lost ends than the limit meets them by a shuffle, with the same outcome."""
    import hashlib

    from stratagraph.graph import of_rows
    from stratagraph.sources import snapshots

    monkeypatch.setattr(snapshots, "BROADCAST_IDS", limit, raising=False)
    big = lambda i: '{"method":"' + "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(16)) + '"}'
    nodes = [{"id": f"n{i}", "type": "api_route", "metadata": f'{{"route":"/{i}"}}'} for i in range(40)]
    calls = [{"id": f"c{i}", "source": f"n{i % 40}", "target": f"n{i * 7 % 40}", "type": "calls_api", "metadata": big(i)} for i in range(1500)]
    odd = [{"source": "n1", "target": f"gone{i}", "type": "renders"} for i in range(5)] + [{"source": "gone1", "target": "n1", "type": "what", "metadata": "3"}, {"source": "n2", "target": "n3", "type": "handles", "metadata": "[]"}]
    odd += [{"id": "none", "source": None, "target": "n3", "type": None}, {"id": "half", "source": "n4", "target": None, "type": "renders"}, {"source": "n4", "target": "n5", "type": "renders"}, {"id": "typeless", "source": "n4", "target": "n5", "type": None}]
    g = of_rows(spark, nodes, calls + odd)
    g.nodes.write.parquet(str(tmp_path / "nodes"))
    g.edges.write.parquet(str(tmp_path / "edges"))
    g = snapshots.Graph(*(spark.read.parquet(str(tmp_path / what)) for what in ("nodes", "edges")))
    before, store = _shuffled(spark), snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    report = store.commit(g)
    if limit:
        assert _shuffled(spark) - before < 200_000
    assert (report.attempted_edges, report.rejected) == (1511, {"missing_source": 2, "missing_target": 6, "invalid_metadata": 1})
    got = store.load()
    assert got.graph.edges.count() == report.written_edges == 1502 and "reason" not in got.typed.edges.columns
    assert {r["id"]: r["type"] for r in got.graph.edges.where("type <> 'calls_api'").collect()} == {"n4--renders--n5": "renders", "typeless": "imports"}
    assert {(r["type"], r["n"]) for r in got.stats.where("what = 'edge'").collect()} == {("calls_api", 1500), ("renders", 1), ("imports", 1)}
    assert got.typed.nodes.where("route = '/7'").first()["id"] == "n7" and got.digest == report.digest
