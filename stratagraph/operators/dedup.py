"""Deduplication, sanitizing and endpoint checks. Keep-first and keep-last follow the ordinal, never the row order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def keep_first(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the first. A partial aggregation, so only one row for each key and task is shuffled."""
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), "ord").alias("_row")).select("_row.*")


def keep_last(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the value of the last at the place of the first."""
    picked = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*df.columns), "ord").alias("_row"), F.min("ord").alias("_ord"))
    return picked.select(*[F.col("_ord").alias("ord") if c == "ord" else F.col(f"_row.{c}") for c in df.columns])


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    return keep_last(nodes, "id")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return keep_first(edges, "id")


def dangling(graph: Graph) -> DataFrame:
    """Edges with an end that is no node."""
    ids = graph.nodes.select("id").distinct()
    at_source = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    rest = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    at_target = rest.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return at_source.select(*graph.edges.columns).unionByName(at_target.select(*graph.edges.columns))


def without_dangling(graph: Graph, exempt: tuple[str, ...] = ()) -> Graph:
    """The graph without dangling edges, but for edges of the exempt types."""
    ids = graph.nodes.select("id").distinct()
    checked = graph.edges.where(~F.col("type").isin(*exempt)) if exempt else graph.edges
    kept = checked.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    kept = kept.select(*graph.edges.columns)
    return Graph(graph.nodes, kept.unionByName(graph.edges.where(F.col("type").isin(*exempt))) if exempt else kept)


def _ends(graph: Graph) -> DataFrame:
    """Edges with flags of whether each end is a node."""
    ids = graph.nodes.select("id").distinct()
    flagged = graph.edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("has_source")), "source", "left")
    flagged = flagged.join(ids.select(F.col("id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    return flagged.select(*graph.edges.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_source", "has_target")])


@dataclass(frozen=True)
class Sanitized:
    graph: Graph
    removed: DataFrame  # one row: self_loop, dangling, duplicate, kept


def sanitize(graph: Graph) -> Sanitized:
    """The graph without self loops, dangling and repeated edges, and how many went for each reason. Equal edges are counted
    into one row before their ends are looked up."""
    keys = graph.edges.groupBy("source", "type", "target").agg(F.count("*").alias("n"))
    ok = (F.col("source") != F.col("target")) & F.col("has_source") & F.col("has_target")
    loop = F.col("source") == F.col("target")
    total = lambda n, when: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).alias
    counts = _ends(Graph(graph.nodes, keys)).agg(
        total(F.col("n"), loop)("self_loop"), total(F.col("n"), ~F.coalesce(loop | ok, F.lit(False)))("dangling"),
        total(F.col("n") - 1, ok)("duplicate"), F.count_if(ok).alias("kept"),
    )
    return Sanitized(Graph(graph.nodes, sanitized_edges(graph)), counts)


def sanitized_edges(graph: Graph) -> DataFrame:
    """The edges that `sanitize` keeps, by a partial aggregation in place of the window."""
    whole = graph.edges.where("source <> target")
    kept = without_dangling(Graph(graph.nodes, whole)).edges
    return keep_first(kept, "source", "type", "target").select(*graph.edges.columns)


def endpoint_report(graph: Graph) -> DataFrame:
    """Edges by verdict: ok, missing_source (also if both miss), missing_target."""
    verdict = F.when(~F.col("has_source"), "missing_source").when(~F.col("has_target"), "missing_target").otherwise("ok")
    return _ends(graph).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def is_object(metadata: str = "metadata") -> Column:
    """Whether a text is a JSON object; the empty one, which most edges have, isn't parsed."""
    return (F.col(metadata) == "{}") | F.coalesce(F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), F.lit(False))


def with_reasons(graph: Graph) -> DataFrame:
    """All edges, with the reason for which a commit refuses them: a missing end, or metadata that is no JSON object; else null."""
    bad = ~F.coalesce(is_object(), F.lit(False))
    reason = F.when(~F.col("has_source"), "missing_source").when(~F.col("has_target"), "missing_target").when(bad, "invalid_metadata")
    return _ends(graph).withColumn("reason", reason).drop("has_source", "has_target")


def rejected_edges(graph: Graph) -> DataFrame:
    """Edges that a commit refuses, with the reason."""
    return with_reasons(graph).where("reason is not null")


def merge_coverage(*stages: DataFrame) -> DataFrame:
    """Coverage edges of several stages: the earlier stays, unless a later one is certain where it was inferred."""
    rows = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    rank = F.struct((F.col("confidence") == "certain").cast("int"), -F.col("_stage"), *[-F.col(f"ord.{f}") for f in ("stage", "file", "parser", "emit")])
    return whole.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*stages[0].columns), rank).alias("_row")).select("_row.*")


def new_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of `after` whose id `before` has not."""
    return after.join(before.select("id").distinct(), "id", "left_anti")
