"""The public surface over a snapshot store: graph queries, tests, tools, and a command line.

Values that don't exist in the model raise ValueError; what isn't found gives an empty frame or None."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import coverage, detect, joins, lookup, stats, traverse
from .operators.dedup import sanitize
from .plans.analyze import analyze
from .sources.junit import read_results, result_files, unmatched
from .sources.snapshots import SnapshotStore
from .streaming.watch import Freshness


class Workspace:
    """A project and its snapshots. Each query reads the latest snapshot, so a commit by another process shows at once."""

    def __init__(self, spark: SparkSession, store: str, root: str | None = None):
        self.spark, self.store, self.root = spark, SnapshotStore(spark, store), root
        self.freshness = Freshness()

    @property
    def graph(self) -> Graph:
        got = self.store.load()
        if got is None:
            raise LookupError("nothing has been analysed yet")
        return got.graph

    def analyze(self, **options):
        self.freshness.state = "analyzing"
        out = analyze(self.spark, self.root, self.store, **options)
        self.freshness = Freshness("fresh", self.store.latest()["created_ms"], 0)
        return out

    # Graph

    def nodes(self, type_: str | None = None) -> DataFrame:
        return self.graph.nodes if type_ is None else lookup.nodes_by_type(self.graph, type_)

    def node(self, id_: str) -> dict | None:
        rows = lookup.node(self.graph, id_).take(1)
        return rows[0].asDict() if rows else None

    def node_edges(self, id_: str) -> DataFrame:
        return lookup.edges_of(self.graph, id_)

    def edges(self, type_: str | None = None) -> DataFrame:
        return self.graph.edges if type_ is None else lookup.edges_by_type(self.graph, type_)

    def stats(self) -> DataFrame:
        return stats.type_counts(self.graph)

    def removed(self) -> dict:
        return sanitize(self.graph).removed.first().asDict()

    def errors(self, file: str | None = None, severity: str | None = None) -> DataFrame:
        return lookup.errors(self.store.load().errors, file, severity)

    def issues(self, by: str = "rank") -> DataFrame:
        """By severity and place, or by id."""
        found = self.store.load().issues
        return found.orderBy(F.collate(F.col("id"), "UNICODE")) if by == "id" else detect.ranked_issues(found)

    def issue_summary(self) -> dict:
        return detect.issue_summary(self.store.load().issues).first().asDict()

    def findings(self) -> DataFrame:
        snapshot = self.store.load()
        return detect.findings(snapshot.errors, snapshot.issues).orderBy("rank", "file", "line")

    def trace(self, node: str) -> DataFrame:
        graph = self.graph
        if not lookup.node(graph, node).take(1):
            raise LookupError(f"no node {node}")
        return traverse.explained(traverse.linear_traces(graph, graph.nodes.where(F.col("id") == node).select("id"))).orderBy("index")

    def dataflow(self, model: str) -> DataFrame:
        """Flow edges of the models of a name, or whose id holds it."""
        graph = self.graph
        models = graph.nodes.where("type = 'db_model'").where((F.lower("name") == model.lower()) | F.contains("id", F.lit(model)))
        return traverse.model_flows(graph, models.select("id"))

    def clear(self):
        return self.store.clear()

    def health(self) -> dict:
        latest = self.store.latest()
        return {"ok": True, "snapshot": latest and latest["snapshot_id"], "digest": latest and latest["digest"]}

    def status(self) -> dict:
        return vars(self.freshness) | self.health()

    def view(self, name: str, **options):
        return traverse.view(self.graph, name, **options)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return lookup.search(self.graph, text).orderBy("ord").limit(limit)

    # Tools

    def get_api_routes(self, text: str | None = None) -> DataFrame:
        return lookup.api_routes(self.graph, text)

    def get_component_tree(self, target: str, depth=None) -> DataFrame:
        return traverse.component_tree(self.graph, target, lookup.valid_depth(depth, 3))

    def find_callers(self, target: str) -> tuple[DataFrame, DataFrame]:
        return traverse.find_callers(self.graph, target)

    def list_db_models(self) -> DataFrame:
        return lookup.db_models(self.graph)

    def get_dataflow(self, model: str) -> DataFrame:
        return self.dataflow(model)

    def get_test_coverage(self, framework: str | None = None, target: str | None = None) -> coverage.TestView:
        return coverage.project(self.graph, framework, target)

    def neighbours(self, id_: str, down: bool = True, types=None) -> DataFrame:
        return (joins.downstream if down else joins.upstream)(self.graph, id_, types)

    def import_tests(self, pattern: str) -> dict:
        """Totals of JUnit results, and how many fit no known case."""
        results = read_results(self.spark, result_files(self.root, pattern))
        totals = stats.import_totals(results).first().asDict()
        return totals | {"unmatched": unmatched(results, self.graph.nodes).count()}


def export_json(graph: Graph, path: str) -> None:
    """The graph as JSON lines, nodes and edges in a folder each."""
    graph.nodes.drop("ord").write.json(f"{path}/nodes")
    graph.edges.drop("ord").write.json(f"{path}/edges")


def envelope(workspace: Workspace) -> str:
    """A small graph as one JSON text with counts."""
    graph = workspace.graph
    rows = lambda df: [json.loads(x) for x in df.drop("ord").toJSON().collect()]
    return json.dumps({"nodes": rows(graph.nodes), "edges": rows(graph.edges), "issues": workspace.issue_summary()}, sort_keys=True)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratagraph", description="Analyse a source tree as a graph.")
    parser.add_argument("command", choices=("analyze", "check", "test-import"))
    parser.add_argument("root")
    parser.add_argument("--store", help="snapshot folder; .stratagraph in the root by default")
    parser.add_argument("--json", action="store_true", help="print the graph as JSON")
    parser.add_argument("--results", default="**/junit*.xml", help="glob of result files for test-import")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("stratagraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    work = Workspace(spark, given.store or str(Path(given.root) / ".stratagraph"), given.root)
    if given.command == "test-import":
        print(json.dumps(work.import_tests(given.results)))
        return 0
    out = work.analyze()
    if given.json:
        print(envelope(work))
        return 0
    counts = {(r["what"], r["type"]): r["n"] for r in work.stats().collect()}
    print(f"{sum(n for (w, _), n in counts.items() if w == 'node')} nodes, {sum(n for (w, _), n in counts.items() if w == 'edge')} edges, {out.errors.count()} parse errors")
    summary = work.issue_summary()
    for kind, n in sorted((r["type"], r["n"]) for r in work.store.load().issues.groupBy("type").agg(F.count("*").alias("n")).collect()):
        print(f"  {kind}: {n}")
    for row in work.issues().where("severity = 'critical'").limit(10).collect():
        print(f"  critical: {row['description']}")
    return int(given.command == "check" and summary["critical"] > 0)


if __name__ == "__main__":
    sys.exit(main())
