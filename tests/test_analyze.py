"""A small project of our own from sources to snapshot."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph.api import Workspace
from stratagraph.extract.code import Source, mask
from stratagraph.extract.registry import Registry
from stratagraph.graph import of_rows
from stratagraph.plans.analyze import Aborted, NoSources, analyze
from stratagraph.sources.files import collect_files, detect_project, file_kind, load_config
from stratagraph.sources.snapshots import SnapshotStore
from stratagraph.streaming.watch import Watcher, difference, event_counts, request_limits, user_sessions

FILES = {
    "package.json": '{"dependencies": {"next": "1", "express": "4", "@prisma/client": "5", "@trpc/server": "1"}}',
    "schema.prisma": 'model Order {\n  id Int @id\n  note String?\n  lines Line[]\n  @@map("order_table")\n}\nmodel Line {\n  id Int @id\n  order Order @relation(fields: [orderId], references: [id])\n  orderId Int\n}\n',
    "app/shop/[id]/page.tsx": "import { Cart } from '../../../components/Cart'\nexport default function ShopPage() {\n  return <Cart />\n}\n",
    "components/Cart.tsx": "'use client'\nimport { useState } from 'react'\nexport function Cart({ size, tone }) {\n  const [n] = useState(0)\n  fetch('/api/orders', { method: 'POST' })\n  // fetch('/api/never')\n  return <Button />\n}\nexport const Button = () => <b>go</b>\n",
    "app/api/orders/route.ts": "import { createOrder } from '../../../lib/orders'\nexport async function POST(req) {\n  return createOrder(req)\n}\n",
    "lib/orders.ts": "import { prisma } from './db'\nexport async function createOrder(req) {\n  for (const line of req.lines) {\n    await prisma.line.create({ data: line })\n  }\n  return prisma.order.create({ data: {} })\n}\n",
    "server/routes/users.ts": "const router = express.Router()\nrouter.use('/v1')\nrouter.get(`/users/${user.id}`, listUsers)\nfunction listUsers(req, res) {\n  requireAuth(req)\n}\n",
    "server/routers/post.ts": "export const postRouter = router({\n  list: publicProcedure.input(z.string()).query(() => 1),\n  add: publicProcedure.mutation(() => 2),\n})\n",
    "lib/orders.test.ts": "import { describe, it, expect, beforeEach } from 'vitest'\nimport { createOrder } from './orders'\ndescribe('orders', () => {\n  beforeEach(() => {})\n  it('creates', () => { createOrder({}) })\n  it.skip('waits', () => {})\n  test.each([1, 2])('n %i', () => { fetch('/api/orders') })\n})\n",
    "node_modules/x/index.ts": "export const no = 1",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def analysed(spark, project, tmp_path_factory):
    work = Workspace(spark, str(tmp_path_factory.mktemp("store")), project)
    return work, work.analyze()


def test_sources(project):
    assert collect_files(project) == sorted(p for p in FILES if p.endswith((".ts", ".tsx", ".prisma")) and "node_modules" not in p)
    found = detect_project(project)
    assert (found.frontend, found.backend, found.database) == (["next"], ["trpc", "express"], ["prisma"])


def test_links_are_not_followed_out_of_the_root(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.ts").write_text("")
    (tmp_path / "in" / "a.ts").write_text("")
    (tmp_path / "in" / "link.ts").symlink_to(tmp_path / "out.ts")
    (tmp_path / "in" / "loop").symlink_to(tmp_path / "in")
    assert collect_files(str(tmp_path / "in")) == ["a.ts"]


def test_config_fields_fall_back_one_by_one(tmp_path):
    (tmp_path / "stratagraph.config.json").write_text('{"debounceMs": "x", "dirs": ["src"], "what": 1}')
    config, warnings = load_config(str(tmp_path))
    assert config["debounceMs"] == 1000 and config["dirs"] == ["src"] and len(warnings) == 2


def test_file_kinds(spark):
    rows = spark.createDataFrame([("app/a/page.tsx",), ("app/api/route.ts",), ("a/x.test.ts",), ("a.prisma",), ("b.txt",)], "path string")
    assert [r[0] for r in rows.select(file_kind()).collect()] == ["page", "api_route", "test", "schema", "other"]


def test_whole_chain(analysed):
    _, out = analysed
    edges = {(r.source, r.type, r.target) for r in out.graph.edges.collect()}
    for edge in [
        ("page:app/shop/[id]/page.tsx:/shop/[id]", "renders", "component:components/Cart.tsx:Cart"),
        ("component:components/Cart.tsx:Cart", "calls_api", "api_route:app/api/orders/route.ts:/api/orders"),
        ("component:components/Cart.tsx:Cart", "renders", "component:components/Cart.tsx:Button"),
        ("api_route:app/api/orders/route.ts:/api/orders", "handles", "handler:app/api/orders/route.ts:POST"),
        ("handler:app/api/orders/route.ts:POST", "calls_service", "service:app/api/orders/route.ts:createOrder"),
        ("db_model:schema.prisma:Order", "db_relation", "db_model:schema.prisma:Line"),
        ("test_suite:lib/orders.test.ts:orders", "tests", "test_case:lib/orders.test.ts:orders > creates"),
    ]:
        assert edge in edges, edge
    assert not any(":unknown:" in t for _, _, t in edges)
    ids = {r.id for r in out.graph.nodes.select("id").collect()}
    assert all(s in ids and t in ids for s, _, t in edges)
    assert out.failed_detectors == {}


def test_nodes(analysed):
    _, out = analysed
    meta = {r.id: json.loads(r.metadata) for r in out.graph.nodes.collect()}
    assert meta["db_model:schema.prisma:Order"]["tableName"] == "order_table" and meta["db_model:schema.prisma:Order"]["fieldCount"] == 2
    assert meta["component:components/Cart.tsx:Cart"]["props"] == ["size", "tone"] and meta["component:components/Cart.tsx:Cart"]["hasState"]
    assert meta["page:app/shop/[id]/page.tsx:/shop/[id]"]["params"] == ["id"]
    assert meta["api_route:server/routes/users.ts:GET /v1/users/:id"]["method"] == "GET"
    assert meta["trpc_procedure:server/routers/post.ts:post.list"]["hasInput"] and meta["trpc_procedure:server/routers/post.ts:post.add"]["procedureType"] == "mutation"
    assert meta["test_case:lib/orders.test.ts:orders > waits"]["disabled"] and meta["test_case:lib/orders.test.ts:orders > n %i"]["isParameterized"]


def test_issues(analysed):
    work, out = analysed
    kinds = {r.type for r in out.issues.collect()}
    assert "unguarded_route" in kinds and "dead_api_call" not in kinds
    assert work.issue_summary()["total"] == out.issues.count()


def test_reruns_agree(spark, project, analysed):
    _, out = analysed
    again = analyze(spark, project)
    assert again.digest == out.digest and again.source_digest == out.source_digest


def test_workspace_queries(analysed):
    work, _ = analysed
    assert work.get_api_routes("orders").count() == 1
    assert sorted(r["name"] for r in work.list_db_models().collect()) == ["Line", "Order"]
    assert [r.node_id.split(":")[0] for r in work.trace("api_route:app/api/orders/route.ts:/api/orders").collect()][:3] == ["page", "component", "api_route"]
    assert work.get_test_coverage().summary.first()["cases"] == 3
    assert work.node("nothing") is None and work.health()["ok"]
    with pytest.raises(LookupError):
        work.trace("nothing")
    with pytest.raises(ValueError):
        work.nodes("nonsense")


def test_abort_and_no_sources(spark, project, tmp_path):
    with pytest.raises(Aborted):
        analyze(spark, project, aborted=lambda: True)
    with pytest.raises(NoSources):
        analyze(spark, str(tmp_path))


def test_a_failing_extractor_gives_an_error_row():
    registry = Registry()
    registry.register("bad", lambda p, t, m: True, lambda s, m: 1 / 0)
    errors = [e for _, _, out in registry.run("a.txt", "x", {}) for e in out.errors]
    assert len(errors) == 1 and errors[0]["code"] == "EXTRACTOR_FAILED"


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.load() is None
    g = of_rows(spark, [{"id": "a", "type": "page"}, {"id": "b", "type": "odd"}], [{"source": "a", "type": "renders", "target": "b"}, {"source": "a", "type": "renders", "target": "gone"}])
    report = store.commit(g)
    assert (report.attempted_edges, report.written_edges, report.rejected) == (2, 1, {"missing_target": 1})
    got = store.load()
    assert {r.id: r.type for r in got.graph.nodes.collect()} == {"a": "page", "b": "module"}
    with pytest.raises(Exception):
        store.commit(of_rows(spark, [{"id": "c", "type": "page"}], []), errors=spark.sql("select raise_error('disk') as file"))
    assert store.load().id == got.id
    store.upsert_nodes(of_rows(spark, [{"id": "a", "type": "page", "name": "new"}], []).nodes)
    assert {r.id: r["name"] for r in store.load().graph.nodes.collect()}["a"] == "new"
    store.delete(node_ids=["b"])
    assert store.load().graph.edges.count() == 0 and store.load().graph.nodes.count() == 1
    store.clear()
    assert store.load().graph.nodes.count() == 0 and store.history().count() == 4


def test_junit(spark, tmp_path, project):
    from pyspark.errors import PythonException

    from stratagraph.sources.junit import read_results, result_files

    (tmp_path / "junit.xml").write_text('<testsuites><testsuite name="s"><testcase name="a" time="0.5"/><testsuite name="t"><testcase name="b" time="x"><failure message="no"/></testcase></testsuite><testcase name="c"><skipped/></testcase></testsuite></testsuites>')
    rows = [tuple(r) for r in read_results(spark, result_files(str(tmp_path), "*.xml")).collect()]
    assert rows == [("s", "a", "passed", 500.0, None), ("t", "b", "failed", 0.0, "no"), ("s", "c", "skipped", 0.0, None)]
    (tmp_path / "bad.xml").write_text('<!DOCTYPE x [<!ENTITY e "x">]><testsuites/>')
    with pytest.raises(PythonException):
        read_results(spark, [str(tmp_path / "bad.xml")]).collect()
    with pytest.raises(FileNotFoundError):
        result_files(str(tmp_path), "*.none")


def test_mask_keeps_places():
    text = "a('x // y') // c\nb(`t ${f('z')} u`) /* q */ d"
    code = mask(text)
    assert len(code) == len(text) and "y" not in code and "f('" in code and "q" not in code and code.index("d") == text.rindex("d")


def test_code_helpers():
    s = Source("a.ts", "import d, { x as y, type Z } from './m'\nexport const f = async (a) => {\n  g(1, [2, 3], 'x')\n}\nclass K { m(p) { return 1 } }\n")
    assert s.imports()[0]["names"] == {"y": "x", "Z": "Z", "d": "default"}
    assert [f["name"] for f in s.functions()] == ["f", "m"]
    assert [s.raw(a) for a in s.arguments(s.code.index("g(") + 1)] == ["1", "[2, 3]", "'x'"]


def run(path, text, **meta):
    nodes, edges = [], []
    for _, _, out in Registry().run(path, text, meta):
        assert not out.errors, out.errors
        nodes += out.nodes
        edges += out.edges
    return {x["id"]: x["metadata"] for x in nodes}, {(x["source"], x["type"], x["target"]): x["metadata"] for x in edges}


def test_nest():
    text = "@Controller('orders')\nexport class OrdersController {\n  @Get(':id')\n  async one(@Param() p) {}\n  @Post()\n  add() {}\n}\n"
    nodes, edges = run("src/orders.controller.ts", text, backend="nestjs")
    assert "api_route:src/orders.controller.ts:GET /orders/:id" in nodes and nodes["handler:src/orders.controller.ts:OrdersController.add"]["functionName"] == "add"
    nodes, edges = run("src/a.service.ts", "@Injectable()\nexport class A {\n  constructor(@InjectRepository(User) private r: Repository<User>) {}\n}", backend="nestjs")
    assert ("service:src/a.service.ts:A", "queries_db", "db_model:src/a.service.ts:User") in edges
    nodes, _ = run("src/app.module.ts", "@Module({ controllers: [A, B], providers: [C] })\nexport class AppModule {}", backend="nestjs")
    assert nodes["module:src/app.module.ts:AppModule"]["childCount"] == 3


def test_models():
    text = "@Entity('people')\nexport class User {\n  @PrimaryGeneratedColumn()\n  id: number\n  @Column({ nullable: true })\n  name?: string\n  @OneToMany(() => Post, p => p.user)\n  posts: Post[]\n}\n"
    nodes, edges = run("src/entity/User.ts", text, database="typeorm")
    assert nodes["db_model:src/entity/User.ts:User"]["tableName"] == "people" and nodes["db_model:src/entity/User.ts:User"]["fieldCount"] == 2
    assert edges[("db_model:src/entity/User.ts:User", "db_relation", "db_model:src/entity/User.ts:Post")]["relationType"] == "one_to_many"
    text = "export const users = pgTable('user_table', {\n  id: serial('id').primaryKey(),\n  name: varchar('name').notNull(),\n})\nexport const r = relations(users, ({ one, many }) => ({ posts: many(posts), org: one(orgs, {}) }))\n"
    nodes, edges = run("src/schema.ts", text, database="drizzle")
    fields = nodes["db_model:src/schema.ts:users"]["fields"]
    assert [(f["name"], f["type"], f["isId"]) for f in fields] == [("id", "serial", True), ("name", "varchar", False)]
    assert {k[2].split(":")[-1]: v["relationType"] for k, v in edges.items()} == {"posts": "one_to_many", "orgs": "many_to_one"}


def test_tsrpc_and_pages():
    nodes, edges = run("src/protocols/user/PtlLogin.ts", "export interface ReqLogin {}\nexport interface ResLogin {}\n", backend="tsrpc")
    assert nodes["tsrpc_api:src/protocols/user/PtlLogin.ts:Login"]["apiPath"] == "user/Login"
    _, edges = run("src/calls.ts", "client.callApi('user/Login', {})\nclient.listenMsg('Chat', () => {})\n")
    assert {(k[1], k[2]) for k in edges} == {("calls_api", "tsrpc_api:unknown:user/Login"), ("listens_msg", "tsrpc_msg:unknown:Chat")}
    nodes, _ = run("pages/api/x/index.ts", "export default function h(req) { if (req.method === 'POST') {} }", frontend="next")
    assert nodes["api_route:pages/api/x/index.ts:/api/x"]["method"] == "POST"


def test_kotlin():
    text = '@Entity\ndata class Person(@Id val id: Long, val name: String?) : Base(), Named\nopen class Base\ninterface Named\n@RestController\nclass Api {\n  @GetMapping("/p")\n  fun list() = 1\n}\n'
    nodes, edges = run("src/A.kt", text, backend="spring")
    assert nodes["kotlin_class:src/A.kt:Person"]["kind"] == "data" and nodes["db_model:src/A.kt:Person"]["fieldCount"] == 2
    assert ("kotlin_class:src/A.kt:Person", "kotlin_inherits", "kotlin_class:src/A.kt:Base") in edges and ("kotlin_class:src/A.kt:Person", "kotlin_implements", "kotlin_interface:src/A.kt:Named") in edges
    assert nodes["kotlin_route:src/A.kt:list"]["method"] == "GET"
    nodes, _ = run("src/R.kt", 'fun Route.x() { get("/a") { }\n post("/b/{id}") { } }', backend="ktor")
    assert sorted(n.split(":", 2)[2] for n in nodes if n.startswith("kotlin_route")) == ["GET /a", "POST /b/{id}"]
    nodes, edges = run("src/D.kt", '@Entity(tableName = "t")\ndata class E(@PrimaryKey val id: Int)\n@Dao\ninterface D {\n  @Query("SELECT 1")\n  fun all(): List<E>\n}\n', database="room")
    assert nodes["db_model:src/D.kt:E"]["tableName"] == "t" and any(k[2].endswith(":unknown") for k in edges)
    nodes, edges = run("src/T.kt", 'object Users : IntIdTable("u") {\n  val name = varchar("n", 5)\n  val org = reference("o", Orgs)\n}\n', database="exposed")
    assert nodes["db_model:src/T.kt:User"]["tableName"] == "u" and ("db_model:src/T.kt:User", "db_relation", "db_model:src/T.kt:Org") in edges


def test_test_frameworks():
    nodes, _ = run("src/test/K.kt", "import org.junit.jupiter.api.Test\nclass K {\n  @BeforeEach fun up() {}\n  @Test\n  fun `does it`() {}\n  @Disabled @Test fun off() {}\n}\n")
    assert nodes["test_case:src/test/K.kt:does it"]["framework"] == "junit5" and nodes["test_case:src/test/K.kt:off"]["disabled"]
    nodes, _ = run("src/test/S.kt", 'import io.kotest.core.spec.style.FunSpec\nclass S : FunSpec({\n  beforeTest { }\n  test("adds") { }\n})\n')
    assert "test_case:src/test/S.kt:S > adds" in nodes
    nodes, edges = run("e2e/a.spec.ts", "import { test as base } from '@playwright/test'\nconst test = base.extend({ user: async ({}, use) => {} })\ntest('logs in', async ({ user }) => {})\n")
    assert any(k[1] == "uses_fixture" for k in edges)
    nodes, _ = run("cypress/e2e/a.cy.ts", "describe('x', () => { before(() => {}); it('y', () => { cy.visit('/') }) })")
    assert nodes["test_case:cypress/e2e/a.cy.ts:x > y"]["framework"] == "cypress"


def test_watcher(spark, tmp_path):
    (tmp_path / "a.ts").write_text("1")
    results, fail = [], []

    def work(root):
        if fail:
            raise RuntimeError("down")
        if results == ["switch"]:
            watch.switch(str(tmp_path))
        return root

    watch = Watcher(str(tmp_path), work, results.append, debounce_s=1.0)
    assert not watch.poll(0.0) and watch.freshness.pending == 1
    assert watch.poll(1.5) and watch.freshness.state == "fresh" and not watch.poll(3.0)
    (tmp_path / "a.ts").write_text("2")
    fail.append(1)
    assert not watch.poll(4.0) and not watch.poll(6.0) and watch.freshness.state == "stale"
    fail.clear()
    assert watch.poll(7.0)
    results[:] = ["switch"]
    (tmp_path / "a.ts").unlink()
    (tmp_path / "b.kt").write_text("")
    watch.poll(8.0)
    assert not watch.poll(10.0) and watch.events[-1][0] == "discarded"
    assert difference({"a": "1", "b": "2"}, {"b": "3", "c": "4"}) == {"a": "deleted", "b": "changed", "c": "added"}


def test_event_windows(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:01' AS ts, 1L AS user_id, 'view' AS event_type, 1.0D AS value UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:59', 1, 'view', 2.0 UNION ALL SELECT timestamp_ntz'2024-01-01 02:00:00', 1, 'view', 3.0")
    assert sorted((r.n, r.value) for r in event_counts(rows).collect()) == [(1, 3.0), (2, 3.0)]
    assert sorted(r.n for r in user_sessions(rows).collect()) == [1, 2]
    assert sorted(r.allowed for r in request_limits(rows, 1).collect()) == [False, True]


def test_event_stream(spark, tmp_path):
    source = tmp_path / "events"
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:01' AS ts, 1L AS user_id, 'view' AS event_type, 1.0D AS value").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp_ntz, user_id long, event_type string, value double").parquet(str(source))
    query = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert spark.table("counts").select(F.sum("n")).first()[0] == 1


def test_sql_functions(spark):
    from stratagraph.functions.columns import register

    register(spark)
    row = spark.sql("SELECT graph_normalize_url('a/b/?q=1') AS u, graph_trace_layer('handler') AS l, graph_node_id('a', 'b', 'c') AS i, graph_severity_rank('info') AS s").first()
    assert tuple(row) == ("/a/b", "logic", "a:b:c", 3)
