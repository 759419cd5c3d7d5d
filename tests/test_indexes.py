"""Indexes, as-of joins, doubled walks and stateful folds against brute force on small inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stratagraph.graph import of_rows
from stratagraph.operators import asof, reachability, traverse
from stratagraph.plans import link


def reached(edges, seed):
    seen, todo = {seed}, [seed]
    while todo:
        at = todo.pop()
        new = {t for s, t in edges if s == at} - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("acyclic", [True, False])
def test_reach_index(spark, acyclic):
    rng = random.Random(acyclic)
    ids = [f"n{i:02}" for i in range(60)]
    edges = {tuple(sorted(rng.sample(range(60), 2))) if acyclic else tuple(rng.sample(range(60), 2)) for _ in range(70)}
    edges = {(ids[a], ids[b]) for a, b in edges}
    goals = [*rng.sample(ids, 12), "alone"]
    frame = spark.createDataFrame([*edges, ("n00", "n00")], "source string, target string")
    index = reachability.build(frame, spark.createDataFrame([(g,) for g in goals], "id string"))
    want = {(s, g) for s in [*ids, "alone"] for g in goals if g in reached(edges, s)}
    seeds = spark.createDataFrame([(i,) for i in [*ids, "alone", "unknown"]], "id string")
    assert {tuple(r) for r in reachability.goals_of(index, seeds).collect()} == {p for p in want if p[0] in {i for e in edges for i in e} | {"alone"} or p[0] in goals}
    pairs = [(s, g) for s in [*ids, "alone", "unknown"] for g in [*goals, "unknown"]]
    got = {tuple(r) for r in reachability.reached_pairs(index, spark.createDataFrame(pairs, "seed string, id string")).collect()}
    assert got == {p for p in want if p[0] in {i for e in edges for i in e} | set(goals)}
    # Intervals refuse pairs without a walk, and hold all that are reached.
    asked = spark.createDataFrame(pairs, "seed string, id string").join(index.goals.select("id", "at"), "id").join(index.nodes.withColumnRenamed("id", "seed"), "seed").join(index.labels, "node")
    passed = asked.where(reachability._inside("at", "spans")).select("seed", "id").collect()
    assert got <= {tuple(r) for r in passed} and len(passed) < asked.count()


def test_reach_index_walks_fewer_edges(spark):
    """Components that no page calls are not walked."""
    nodes = [{"id": f"p{i}", "type": "page"} for i in range(3)] + [{"id": f"c{i}", "type": "component"} for i in range(20)] + [{"id": "r", "type": "api_route"}, {"id": "s", "type": "service"}]
    edges = [{"source": f"c{i}", "type": "calls_api", "target": "r"} for i in range(20)] + [{"source": "p1", "type": "calls_api", "target": "r"}, {"source": "r", "type": "handles", "target": "s"}, {"source": "p2", "type": "renders", "target": "c1"}]
    g = of_rows(spark, nodes, edges)
    index = reachability.page_index(g)
    assert index.edges.count() == 2
    seeds = g.nodes.where("id in ('s', 'r', 'p1')").select("id")
    assert sorted(map(tuple, reachability.affected_pages_of(g, seeds, index=index).collect())) == [("r", "p1"), ("s", "p1")]
    one = {r["id"] for r in traverse.affected_pages(g, "s").collect()}
    assert one == {"p1"}
    assert reachability.affected_pages_of(of_rows(spark, [], []), seeds).count() == 0


@pytest.mark.parametrize("acyclic", [True, False])
def test_pairs_by_sets(spark, monkeypatch, acyclic):
    """Pairs of more seeds than a block holds against walks one by one, cycles, repeated rows and seeds that are goals included;
    no index is made."""
    rng = random.Random(acyclic)
    monkeypatch.setattr(reachability, "build", None)
    nodes = [{"id": f"n{i:03}", "type": "page" if i % 7 == 0 else "service"} for i in range(150)]
    edges = [tuple(sorted(rng.sample(range(150), 2))) if acyclic else tuple(rng.sample(range(150), 2)) for _ in range(260)]
    g = of_rows(spark, nodes, [{"source": f"n{b:03}", "type": "queries_db", "target": f"n{a:03}"} for a, b in [*edges, edges[0], (5, 5), (3, 14), (14, 21)]])
    pages = {n["id"] for n in nodes if n["type"] == "page"} | {"n999"}
    ups = {(r["target"], r["source"]) for r in g.edges.collect() if r["target"] not in pages}
    asked = [(s, p) for s in [*(n["id"] for n in nodes), "unknown"] for p in pages if rng.random() < 0.5 or s == p or (s, p) == ("n003", "n014")]
    want = {(s, p) for s, p in asked if p in reached(ups, s) and p != "n999"}
    got = reachability.page_pairs(g, spark.createDataFrame(asked + asked[:50], "seed string, id string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and 0 < len(want) < len(asked)
    assert reachability.page_pairs(of_rows(spark, [], []), spark.createDataFrame(asked, "seed string, id string")).count() == 0
    assert reachability.page_pairs(g, spark.createDataFrame([], "seed string, id string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_reached_buyers_make_no_index(spark, monkeypatch):
    from stratagraph import index_queries

    monkeypatch.setattr(reachability, "build", None)
    assert index_queries.handlers_that_reach_buyers(spark, "/root/testdata/sf0.001").take(1)


def test_nearest(spark):
    rng = random.Random(9)
    right = [(rng.choice("abc"), rng.randrange(200)) for _ in range(60)] + [("hot", p) for p in range(0, 400, 7)] + [("a", None), (None, 5)]
    left = [(rng.choice("abcd"), rng.randrange(-20, 220)) for _ in range(120)] + [("hot", p) for p in range(-5, 420, 3)] * 2 + [("a", None), (None, 4)]
    frames = [spark.createDataFrame(rows, "k string, at long") for rows in (left, right)]
    got = {(r.k, r.at): r.nearest for r in asof.nearest(*frames, ["k"], "at", block=16).collect()}
    want = {}
    for k, at in set(left):
        options = [p for q, p in right if q == k and p is not None]
        if k is not None and at is not None and options:
            want[(k, at)] = min(options, key=lambda p: (abs(p - at), p))
    assert got == want
    around = {(r.k, r.at): (r.before, r.after) for r in asof.around(*frames, ["k"], "at", block=16).collect()}
    for (k, at), found in around.items():
        options = [p for q, p in right if q == k and p is not None]
        assert found == (max((p for p in options if p <= at), default=None), min((p for p in options if p > at), default=None))
    assert asof.nearest(frames[0].limit(0), frames[1], ["k"], "at").count() == asof.nearest(frames[0], frames[1].limit(0), ["k"], "at").count() == 0


def test_nearest_scope_of_handlers(spark):
    """By name first, of several the nearest; else any of the file; ties and lines without a number to the first."""
    scopes = [("f", "GET", 10, "get"), ("f", "POST", 30, "post"), ("f", "GET", 50, "get2"), ("g", "x", 7, "gx"), ("g", "y", 9, "gy")]
    nodes = [("h1", "f", 45, "GET"), ("h2", "f", 30, "GET"), ("h3", "f", 29, "other"), ("h4", "g", 8, "none"), ("h5", "g", 0, "none"), ("h6", "g", None, "y"), ("h7", "nowhere", 1, "x")]
    got = link.nearest_scopes(spark.createDataFrame(nodes, "node_id string, file_path string, line int, wanted string"), spark.createDataFrame(scopes, "file_path string, function string, at int, text string"))
    assert dict(map(tuple, got.collect())) == {"h1": "get2", "h2": "get", "h3": "post", "h4": "gx", "h5": "gx", "h6": "gy"}


# Search


def test_text_index(spark, tmp_path):
    from stratagraph.operators.lookup import search
    from stratagraph.operators.text_index import TextIndex

    rng = random.Random(6)
    names = ["".join(rng.choice("abAB.é") for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["100%_x", "a", None, "Order Items"]
    nodes = [{"id": f"n{i}", "type": "module", "name": name, "file_path": None if i == 5 else f"src/{rng.choice('abc')}{i % 9}/{'x' * (i % 4)}.ts"} for i, name in enumerate(names)]
    g = of_rows(spark, nodes, [])
    index = TextIndex.build(g, str(tmp_path / "index"))
    asked = ["ab", "aba", " BAB ", "src/a", "é", "%_", "100%_x", "zzz", "src/b1/x", "", None, ".ts", "order items", "ababab"]
    for q in asked:
        assert sorted(r.id for r in index.search(q).collect()) == sorted(r.id for r in search(g, q).collect()), q
    got = {tuple(r) for r in index.search_all(spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
    want = {(q.strip().lower(), r.id) for q in asked if (q or "").strip() for r in search(g, q).collect()}
    assert got == want
    plan = index.search("src/b1/x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and plan.count("FileScan") == 1  # candidates come from a checkpoint
    empty = TextIndex.build(of_rows(spark, [], []), str(tmp_path / "empty"))
    assert empty.search("abc").count() == 0 and empty.search("").count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_search_once(spark, most):
    """Against a search one by one; with more beginnings than allowed, or a text with the separator, by an index."""
    from stratagraph.operators.lookup import search
    from stratagraph.operators.text_index import search_once

    rng = random.Random(7)
    names = ["".join(rng.choice("abAB.é") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["100%_x", "a", "ab", None, "Order Items", "x\ny", "p\0q", "abc"]
    nodes = [{"id": f"n{i // 2}", "type": "module", "name": name, "file_path": None if i in (5, 62) else f"src/{rng.choice('abc')}{i % 9}/{'x' * (i % 4)}.ts"} for i, name in enumerate(names)]
    g = of_rows(spark, nodes, [])
    ask = lambda some: spark.createDataFrame([(q,) for q in some], "query string")
    asked = ["ab", "aba", " BAB ", "src/a", "é", "%_", "100%_x", "zzz", "#12", "src/b1/x", "", "  ", None, ".ts", "order items", "ababab", "x\ny", "a", "A", "abc", "abcs", "cs"]
    for some in (asked, [*asked, "p\0q"], ["zzz", "#1"], [None]):
        got = [tuple(r) for r in search_once(g, ask(some), most).collect()]
        want = {(q.strip().lower(), r.id) for q in some if (q or "").strip() for r in search(g, q).collect()}
        assert set(got) == want, some
        assert len(got) == len(want) or most == 3 or "p\0q" in some
    assert search_once(of_rows(spark, [], []), ask(asked), most).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_search_of_many_texts_makes_no_index(spark, monkeypatch):
    from stratagraph import index_queries
    from stratagraph.operators.text_index import TextIndex

    monkeypatch.setattr(TextIndex, "build", None)
    plan = index_queries.search_many(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # neither places nor finds are shuffled


# Fingerprints


def test_merkle_trees(spark):
    from stratagraph.operators import merkle

    schema, rng = "path string, v long, w string", random.Random(2)
    rows = [(f"{'abc'[i % 3]}/{i % 5}/f{i}.ts", i, None if i % 7 == 0 else str(i)) for i in range(60)] + [("top.ts", 1, "x"), ("a/short", 2, None)]
    later = [(p, v + (v == 17), w) for p, v, w in rows if v != 23] + [("b/9/new.ts", 99, "n")]
    tree = lambda some: merkle.build(spark.createDataFrame(some, schema).repartition(3), "path", ["path", "v", "w"], 3)
    a, b = tree(rows), tree(later)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert tree(shuffled).root == a.root != b.root and tree([]).root == ""
    assert merkle.changed_ranges(a, tree(shuffled)).count() == 0
    changed = {(r.level, r.prefix) for r in merkle.changed_ranges(a, b).collect()}
    touched = ["c/2/f17.ts", "c/3/f23.ts", "b/9/new.ts"]
    assert changed == {(k, "/".join(p.split("/")[:k])) for p in touched for k in range(4)}
    assert dict(map(tuple, merkle.changed_rows(a, b, "path").collect())) == {touched[0]: "changed", touched[1]: "removed", touched[2]: "added"}
    both = merkle.merged([tree(rows[:20]).nodes, tree(rows[20:]).nodes]).select("level", "prefix", merkle.digest().alias("d"))
    whole = a.nodes.select("level", "prefix", merkle.digest().alias("d"))
    assert both.exceptAll(whole).count() == whole.exceptAll(both).count() == 0
    assert merkle.changed_rows(tree([]), a, "path").count() == len(rows)


# Limits


def plain_verdicts(rows, per_window, window, in_flight):
    states, out = {}, {}
    for who, id_, at, takes in sorted(rows, key=lambda r: (r[2], r[1])):
        s = states.setdefault(who, {"start": at, "n": 0, "ends": []})
        if at - s["start"] >= window:
            s["start"], s["n"] = at, 0
        s["ends"] = [x for x in s["ends"] if x > at]
        reason = "concurrency" if len(s["ends"]) >= in_flight else "rate" if s["n"] >= per_window else None
        if reason is None:
            s["n"] += 1
            s["ends"].append(at + max(takes or 0, 0))
        out[id_] = (who, at, reason is None, reason)
    return out


def requests(rng, n):
    return [(rng.choice(["a", "b", None, "hot", "hot"]), i, rng.randrange(3000), rng.choice([None, -5, 0, 30, 200, 900])) for i in range(n)]


def test_request_limits_one_by_one(spark):
    from stratagraph.streaming import limits

    rows = requests(random.Random(4), 300)
    schema = "identity string, id long, at long, takes long"
    got = limits.verdicts(spark.createDataFrame(rows, schema).repartition(5), 5, 300, 3).collect()
    assert {r.id: (r.identity, r["at"], r.ok, r.reason) for r in got} == plain_verdicts(rows, 5, 300, 3)
    assert {r.reason for r in got} == {None, "rate", "concurrency"}
    lost = limits.verdicts(spark.createDataFrame([("a", 1, None, 5)], schema), 5, 300, 3).collect()
    assert [(r.ok, r.reason) for r in lost] == [(False, "time")]
    assert limits.verdicts(spark.createDataFrame([], schema), 5, 300, 3).count() == 0
    busy = {r.identity: (r["at"], r.in_flight) for r in limits.busiest(spark.createDataFrame(rows, schema)).collect()}
    for who in ("a", "hot"):
        mine = [(t, t + d) for w, _, t, d in rows if w == who and (d or 0) > 0]
        counts = {t: sum(s <= t < e for s, e in mine) for t, _ in mine}
        most = max(counts.values())
        assert busy[who] == (min(t for t, c in counts.items() if c == most), most)


def test_request_limits_of_a_stream(spark, tmp_path):
    """State goes from one micro-batch to the next; the verdicts are those of one batch."""
    from stratagraph.streaming import limits

    rows = sorted(((w or "none", i, t, d) for w, i, t, d in requests(random.Random(8), 120)), key=lambda r: (r[2], r[1]))
    schema = "identity string, id long, at long, takes long"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    asked = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limits.stream_verdicts(asked, 5, 300, 3).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = spark.table("verdicts").collect()
    assert {r.id: (r.identity, r["at"], r.ok, r.reason) for r in got} == plain_verdicts(rows, 5, 300, 3)


# Deltas


def test_delta_table(spark, tmp_path):
    from stratagraph.sources.deltas import DeltaTable

    frame = lambda *rows: spark.createDataFrame(rows, "id string, ord long, v string")
    table = DeltaTable(spark, str(tmp_path / "t"), frame(("x", 0, "")).schema)
    state = lambda: {r.id: r.v for r in table.read().collect()}
    assert state() == {} and table.delete(frame(("a", 0, ""))) == 0
    table.insert(frame(("a", 1, "first"), ("a", 0, "least"), ("b", 2, "b")))
    table.insert(frame(("a", 3, "late"), ("c", 4, "c")))
    assert state() == {"a": "least", "b": "b", "c": "c"}
    table.upsert(frame(("a", 5, "new"), ("a", 6, "newer"), ("d", 7, None)))
    assert table.delete(frame(("b", 0, ""), ("zz", 0, ""))) == 1
    assert state() == {"a": "newer", "c": "c", "d": None}
    table.compact()
    assert state() == {"a": "newer", "c": "c", "d": None} and len(table._markers()) == 1
    table.insert(frame(("a", 8, "ignored"), ("b", 9, "again")))
    table.upsert(frame(("c", 1, "c2")))
    want = {"a": "newer", "b": "again", "c": "c2", "d": None}
    assert state() == want
    table.compact()
    assert state() == want and DeltaTable(spark, table.path, table.schema).read().count() == 4
    # A delta without a marker, left by a writer that failed, doesn't count.
    frame(("q", 0, "lost")).write.parquet(f"{table.path}/data/orphan")
    assert state() == want


# Exports


def test_exports_lead_to_the_defining_file(spark):
    from stratagraph.plans import exports

    texts = {
        "index.ts": "export * from './a'\nexport * from './b'\n// export * from './gone'\nexport { deep as renamed, default as main } from './c'",
        "a.ts": "export * from './b'; export * from './index' /* a circle */", "b.ts": "import { far } from './c'\nexport { far as near, local as own }",
        "c.ts": "export * as whole from './b'\nexport { x } from './d'", "d.ts": "export { x } from './c'",
    }
    facts = exports.export_facts(spark.createDataFrame(list(texts.items()), "path string, text string"))
    assert {(r.file, r.name, r.specifier, r.wanted) for r in facts.collect()} == {
        ("index.ts", "*", "./a", "*"), ("index.ts", "*", "./b", "*"), ("index.ts", "renamed", "./c", "deep"), ("index.ts", "main", "./c", "default"), ("a.ts", "*", "./b", "*"), ("a.ts", "*", "./index", "*"),
        ("b.ts", "near", None, "far"), ("b.ts", "own", None, "local"), ("c.ts", "whole", "./b", "*"), ("c.ts", "x", "./d", "x"), ("d.ts", "x", "./c", "x"),
    }
    scopes = [("b.ts", "local"), ("c.ts", "far"), ("c.ts", "deep"), ("c.ts", "default"), ("b.ts", "default")]
    known = [(f, "scope", n, None, None) for f, n in scopes] + [("b.ts", "import", "far", "./c", "far")] + [(f, "file", None, None, None) for f in texts]
    rows = spark.createDataFrame(known, "path string, kind string, name string, source string, target string")
    paths = spark.createDataFrame([(f, f"./{t[:-3]}", x) for f in texts for t in [*texts, "gone.ts"] for x in (t, t + "x")], "file string, specifier string, imported string")
    wanted = [("index.ts", n) for n in ("near", "own", "renamed", "main", "local", "default", "x", "nothing")] + [("a.ts", "renamed"), ("a.ts", "near"), ("c.ts", "x"), ("c.ts", "far"), ("d.ts", "x")]
    got = exports.resolve_imports(spark.createDataFrame(wanted, "imported string, wanted string"), rows, facts, paths)
    assert {(r.imported, r.wanted): (r.def_file, r.def_name) for r in got.collect()} == {
        ("index.ts", "near"): ("c.ts", "far"), ("index.ts", "own"): ("b.ts", "local"), ("index.ts", "renamed"): ("c.ts", "deep"), ("index.ts", "main"): ("c.ts", "default"), ("index.ts", "local"): ("b.ts", "local"),
        ("a.ts", "renamed"): ("c.ts", "deep"), ("a.ts", "near"): ("c.ts", "far"), ("c.ts", "far"): ("c.ts", "far"),
    }


def test_call_chains_through_a_barrel(spark):
    from stratagraph.plans import exports, link

    facts = [("a.ts", "scope", "start", None, None, "go(1)"), ("a.ts", "import", "go", "./lib", "run", None), ("lib/index.ts", "file", None, None, None, None), ("lib/more.ts", "file", None, None, None, None), ("lib/b.ts", "scope", "work", None, None, "return 1")]
    df = spark.createDataFrame([(*f, 1, 0) for f in facts], "path string, kind string, name string, source string, target string, value string, line int, emit long")
    texts = [("lib/index.ts", "export * from './more'"), ("lib/more.ts", "export { work as run } from './b'")]
    given = exports.export_facts(spark.createDataFrame(texts, "path string, text string"))
    starts = spark.createDataFrame([("a.ts#start",)], "id string")
    assert {r.id for r in link.call_chains(df, starts, 5, exports=given).collect()} == {"a.ts#start", "lib/b.ts#work"}
    assert {r.id for r in link.call_chains(df, starts, 5).collect()} == {"a.ts#start"}


# Snapshots


def test_shredded_metadata_reaches_the_files(spark, tmp_path):
    from stratagraph.operators import detect, lookup
    from stratagraph.sources.snapshots import SnapshotStore

    nodes = [{"id": f"r{i}", "type": "api_route", "metadata": f'{{"route":"/api/{i}","method":"GET"}}'} for i in range(5)] + [{"id": "c", "type": "component"}, {"id": "odd", "type": "what"}]
    edges = [{"source": "c", "type": "calls_api", "target": f"r{i}", "metadata": f'{{"method":"{m}"}}'} for i, m in enumerate(("get", "post", "", "GET", "put"))]
    store = SnapshotStore(spark, str(tmp_path))
    store.commit(of_rows(spark, nodes, edges), meta={"root": "x"})
    now = store.load()
    found = lookup.find_by_route(now.typed, "/api/3")
    assert [r.id for r in found.collect()] == ["r3"] and "PushedFilters: [IsNotNull(route), EqualTo(route,/api/3)]" in found._jdf.queryExecution().executedPlan().toString()
    bad = detect.method_mismatches(now.typed)
    assert sorted(r.related_nodes[1] for r in bad.collect()) == ["r1", "r4"]
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "Not(EqualTo(method,))" in plan
    assert now.graph.nodes.where("id = 'odd'").first()["type"] == "module" and "route" not in now.graph.nodes.columns
    assert sorted(r.related_nodes[1] for r in detect.method_mismatches(now.graph).collect()) == ["r1", "r4"]
    store.set_meta("note", 7)
    store.append_errors(spark.createDataFrame([("f.ts", "bad", "error", "p", None)], "file string, message string, severity string, parser string, code string"))
    assert store.get_meta("note") == "7" and store.get_meta("root") == "x" and store.get_meta("none") is None
    assert store.load().errors.count() == 1 and store.load().id == now.id
