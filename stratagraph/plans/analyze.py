"""Analysis of a source tree: scan, extract, link, sanitize, detect, commit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.registry import Registry, extract
from ..graph import Graph
from ..operators import detect
from ..operators.match import PathAliases
from ..operators.dedup import dedup_edges, dedup_nodes, sanitize, sanitized_edges, without_dangling
from ..operators.stats import digests, file_digests, table_digest
from ..runtime import cut
from ..sources.files import collect_files, detect_project, load_config, path_aliases, read_files
from ..sources.snapshots import SnapshotStore, WriteReport
from .link import checked, import_edges, link, link_components, link_tests, shape

PHASES = ("scan", "extract", "build", "tests", "link", "sanitize", "detect", "commit")


class Aborted(RuntimeError):
    """The caller asked to stop between phases."""


class NoSources(ValueError):
    """No file to analyse."""


@dataclass
class Analysis:
    graph: Graph
    errors: DataFrame
    issues: DataFrame
    failed_detectors: dict[str, str]
    removed: dict[str, int]
    source_digest: str
    digest: str
    report: WriteReport | None = None


def detectors(facts: DataFrame, aliases: PathAliases | None = None, present: frozenset[str] | None = None) -> dict[str, detect.Detector]:
    """The default detectors over a graph and its sources' facts; of those only that have input, as far as `present` tells."""
    has = lambda *what: present is None or not present.isdisjoint(what)
    by_name = facts.where("kind = 'scope'").select(F.col("path").alias("file_path"), "name", F.col("value").alias("text"))

    def scopes(graph: Graph) -> DataFrame:
        nodes = graph.nodes.where(F.col("type").isin("api_route", "handler")).select(F.col("id").alias("node_id"), "file_path", F.coalesce(F.get_json_object("metadata", "$.functionName"), F.col("name")).alias("name"))
        own = nodes.join(by_name, ["file_path", "name"]).groupBy("node_id").agg(F.min("text").alias("text"))
        whole = by_name.groupBy("file_path").agg(F.concat_ws("\n", F.collect_list("text")).alias("whole"))
        out = nodes.join(own, "node_id", "left").join(whole, "file_path", "left")
        return out.select("node_id", F.coalesce("text", "whole", F.lit("")).alias("text"))

    directives = facts.where("kind = 'directive'").select(F.col("path").alias("file"), F.col("name").alias("directive"))
    loops = facts.where("kind = 'loop'").select(F.col("path").alias("file"), "line", F.col("name").alias("call"))
    edges = None if present is None else {p.removeprefix("edge:") for p in present if p.startswith("edge:")}
    routes = has(*(f"node:{t}" for t in ("api_route", "trpc_procedure", "tsrpc_api", "express_route", "handler")))
    found: dict[str, detect.Detector] = {"consistency": lambda g: detect.consistency(g, edges)}
    if routes:
        found["auth"] = lambda g: detect.unguarded_routes(g, scopes(g))
    if has("fact:loop"):
        found["n_plus_one"] = lambda g: detect.repeated_queries(g, loops)
    if has("fact:directive"):
        found["rsc"] = lambda g: detect.boundary_violations(g, import_edges(facts, aliases), directives)
    return found


def analyze_files(files: DataFrame, meta: dict, registry: Registry | None = None, extra: dict[str, detect.Detector] | None = None, progress: Callable[[str], None] = lambda phase: None, aborted: Callable[[], bool] = lambda: False, aliases: PathAliases | None = None) -> Analysis:
    """Analysis of files (path, text, ord) under a project's metadata. `extra` adds detectors; aliases resolve imports."""

    def phase(name: str) -> None:
        if aborted():
            raise Aborted(name)
        progress(name)

    phase("extract")
    raw, errors, facts = extract(files, meta, registry)
    phase("build")
    present = shape(raw, facts)  # steps without input are left out; each would cost jobs and find nothing
    has_production = any(p.startswith(("node:", "edge:")) for p in present)
    if has_production:
        production = Graph(dedup_nodes(raw.nodes.where("ord.stage = 0")), dedup_edges(raw.edges.where("ord.stage = 0")))
        if not present.isdisjoint(("node:page", "node:component", "edge:renders")):
            production = link_components(production)
        production = without_dangling(production, exempt=("calls_api",))
        production = Graph(cut(production.nodes), cut(production.edges))
    phase("link")
    if has_production:
        linked = link(production, facts, present)
    phase("tests")
    tests = Graph(dedup_nodes(raw.nodes.where("ord.stage = 1")), dedup_edges(raw.edges.where("ord.stage = 1")))
    both = checked(linked.union(tests) if has_production else tests)
    both = Graph(cut(both.nodes), cut(both.edges))
    if has_production and "case:test" in present:
        covered = link_tests(both, facts, files, aliases)
        both = Graph(both.nodes, both.edges.unionByName(covered.select(*both.edges.columns)))
    phase("sanitize")
    removed = sanitize(both).removed.first().asDict()
    clean = Graph(both.nodes, cut(sanitized_edges(both)))
    phase("detect")
    issues, failed = detect.run_detectors(clean, detectors(facts, aliases, present) | (extra or {}))
    issues = cut(detect.dedup_issues(issues))
    sources = table_digest(file_digests(files.select("path", F.encode("text", "UTF-8").alias("content"))), ["path", "digest"])
    source, digest = digests(clean, sources)
    return Analysis(clean, errors, issues, failed, removed, source, digest)


def analyze(spark: SparkSession, root: str, store: SnapshotStore | None = None, config: dict | None = None, registry: Registry | None = None, progress: Callable[[str], None] = lambda phase: None, aborted: Callable[[], bool] = lambda: False) -> Analysis:
    """Analysis of a project folder; the result is committed if a store is given. A failed commit leaves the last snapshot."""
    progress("scan")
    given, _ = load_config(root) if config is None else (config, [])
    project = detect_project(root, {k: v for k, v in given.items() if v is not None and k in ("frontend", "backend", "database", "dirs")})
    paths = collect_files(root, project.dirs or None)
    if not paths:
        raise NoSources(f"{root} has no supported source files")
    out = analyze_files(read_files(spark, root, paths), project.meta(), registry, None, progress, aborted, path_aliases(root))
    if store is not None:
        if aborted():
            raise Aborted("commit")
        progress("commit")
        out.report = store.commit(out.graph, out.errors, out.issues, {"root": "<root>", "source_digest": out.source_digest, "analyzed_ms": int(time.time() * 1000)})
    return out
