"""Test intelligence: coverage projection and suite groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import TEST_FRAMEWORKS, TEST_TYPES


@dataclass(frozen=True)
class TestView:
    __test__ = False
    suites: DataFrame
    cases: DataFrame
    fixtures: DataFrame
    coverage: DataFrame
    uncovered: DataFrame
    summary: DataFrame  # one row: suites, cases, fixtures, covered_targets, uncovered_targets
    by_framework: DataFrame  # framework, n, every framework


def _framework() -> Column:
    return F.coalesce(F.get_json_object("metadata", "$.framework"), F.lit(TEST_FRAMEWORKS[0]))


def project(graph: Graph, framework: str | None = None, target: str | None = None) -> TestView:
    """The test view under filters: the framework holds for suites, cases, fixtures and the sources of coverage, the target
    (in id or path, or in the name whatever the case) for cases and coverage."""
    tests = graph.nodes.where(F.col("type").isin(*TEST_TYPES))
    tests = tests if framework is None else tests.where(_framework() == framework)
    matches = F.lit(True) if not target else F.contains("id", F.lit(target)) | F.contains(F.lower("name"), F.lit(target.lower())) | F.contains("file_path", F.lit(target))
    coverage = graph.edges.where("type = 'covers'").join(tests.select(F.col("id").alias("source")), "source", "left_semi")
    if target:
        coverage = coverage.join(graph.nodes.where(matches).select(F.col("id").alias("target")), "target", "left_semi")
    cases = tests.where("type = 'test_case'")
    cases = cases.join(coverage.select(F.col("source").alias("id")).distinct(), "id", "left_semi") if target else cases
    suites, fixtures = tests.where("type = 'test_suite'"), tests.where("type = 'test_fixture'")
    production = graph.nodes.where(~F.col("type").isin(*TEST_TYPES)).where(matches)
    uncovered = production.join(coverage.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
    counts = count(suites, "suites").union(count(cases, "cases")).union(count(fixtures, "fixtures"))
    counts = counts.union(count(coverage.select("target").distinct(), "covered_targets")).union(count(uncovered, "uncovered_targets"))
    names = ("suites", "cases", "fixtures", "covered_targets", "uncovered_targets")
    summary = counts.agg(*[F.sum(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])
    by = cases.agg(*[F.count_if(_framework() == f).alias(f) for f in TEST_FRAMEWORKS])
    by = by.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, TEST_FRAMEWORKS)), F.array(*TEST_FRAMEWORKS))).alias("framework", "n"))
    return TestView(suites, cases, fixtures, coverage, uncovered, summary, by)


def suite_groups(graph: Graph, framework: str | None = None, status: str = "all") -> DataFrame:
    """suite_id, cases and fixtures (arrays of ids). Fixtures are those in the suite's file or in one of its cases' files.
    A suite without cases goes only under a status filter."""
    if status not in ("all", "enabled", "disabled"):
        raise ValueError("status must be all, enabled or disabled")
    suites = graph.nodes.where("type = 'test_suite'").select(F.col("id").alias("suite_id"), "file_path", _framework().alias("f"))
    links = graph.edges.where("type = 'tests'").select(F.col("source").alias("suite_id"), F.col("target").alias("case_id")).distinct()
    disabled = F.coalesce(F.get_json_object("metadata", "$.disabled") == "true", F.lit(False))
    cases = graph.nodes.where("type = 'test_case'").select(F.col("id").alias("case_id"), F.col("file_path").alias("case_file"), _framework().alias("cf"), disabled.alias("disabled"))
    inside = links.join(cases, "case_id")
    fixtures = graph.nodes.where("type = 'test_fixture'").select(F.col("id").alias("fixture_id"), "file_path")
    files = suites.select("suite_id", "file_path").union(inside.select("suite_id", "case_file")).distinct()
    fixed = files.join(fixtures, "file_path").groupBy("suite_id").agg(F.sort_array(F.collect_set("fixture_id")).alias("fixtures"))
    if framework is not None:
        suites, inside = suites.where(F.col("f") == framework), inside.where(F.col("cf") == framework)
    if status != "all":
        inside = inside.where("disabled" if status == "disabled" else "not disabled")
    shown = inside.groupBy("suite_id").agg(F.sort_array(F.collect_set("case_id")).alias("cases"))
    nothing = F.array().cast("array<string>")
    out = suites.select("suite_id").join(shown, "suite_id", "left" if status == "all" else "inner").join(fixed, "suite_id", "left")
    return out.select("suite_id", F.coalesce("cases", nothing).alias("cases"), F.coalesce("fixtures", nothing).alias("fixtures"))
