"""Counts and digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import SEVERITIES


def type_counts(graph: Graph) -> DataFrame:
    """what (node or edge), type, n."""
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(graph.nodes, "node").unionByName(count(graph.edges, "edge"))


def build_stats(raw: Graph, built: Graph, errors: int = 0) -> DataFrame:
    """what, type, n of a build: the totals (type null), the nodes and edges it keeps by type, and `skipped_edges`: edges of the
    bag `raw` with an end that `built` has not, calls aside, as those wait for the linker. Repeated edges aren't skipped."""
    ids = built.nodes.select("id").distinct()
    rest = raw.edges.where("type <> 'calls_api'").select("source", "target").join(ids.withColumnRenamed("id", "source").withColumn("_s", F.lit(True)), "source", "left")
    skipped = rest.join(ids.withColumnRenamed("id", "target").withColumn("_t", F.lit(True)), "target", "left").where("_s is null or _t is null")
    by_type = type_counts(built)
    none = F.lit(None).cast("string").alias("type")
    totals = by_type.groupBy(F.concat(F.lit("total_"), "what", F.lit("s")).alias("what")).agg(F.sum("n").alias("n")).select("what", none, "n")
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), none, "n")
    wrong = raw.spark.range(1).select(F.lit("total_errors").alias("what"), none, F.lit(errors).cast("long").alias("n"))
    return by_type.unionByName(totals).unionByName(one("skipped_edges", skipped)).unionByName(wrong)


def severity_counts(rows: DataFrame, severities=SEVERITIES) -> DataFrame:
    """severity, n for every severity, 0 where there is none; one row comes from one aggregation."""
    counts = rows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, severities)), F.array(*severities))).alias("severity", "n"))


def edge_class_counts(graph: Graph, types=("calls_api", "handles", "calls_service", "queries_db")) -> DataFrame:
    return graph.edges.agg(*[F.count_if(F.col("type") == t).alias(t) for t in types])


def types_in_order(graph: Graph) -> DataFrame:
    """type, first_ord, n of the nodes: groups in the order in which a type first shows."""
    return graph.nodes.groupBy("type").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))


def per_file(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types)).groupBy("file_path").agg(F.count("*").alias("n"))


def canonical(*columns: str) -> Column:
    """A row as text with sorted names; nulls are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, digest) that doesn't depend on row order or partitions: row digests are summed as numbers, in Spark."""
    row = F.sha2(canonical(*columns), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("long") for i in range(5)]
    # 48-bit parts are summed as halves of 24 bits, which no number of rows takes out of a long, and put together at the end.
    halves = [h for i in range(5) for h in (F.sum(F.shiftright(f"p{i}", 24)).alias(f"h{i}"), F.sum(F.col(f"p{i}").bitwiseAND(F.lit(0xFFFFFF))).alias(f"l{i}"))]
    whole = lambda i: F.coalesce((F.col(f"h{i}").cast("decimal(38,0)") * F.lit(1 << 24) + F.col(f"l{i}")).cast("decimal(38,0)"), F.lit(0)).cast("string").alias(f"p{i}")
    sums = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(F.count("*").alias("n"), *halves).select("n", *[whole(i) for i in range(5)])
    return sums.select("n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), *[f"p{i}" for i in range(5)]), 256).alias("digest"))


def digests(graph: Graph, *more: DataFrame) -> tuple[str, ...]:
    """The digests of further tables (as from `table_digest`), then that of the graph, all from one job."""
    nodes = table_digest(graph.nodes, ["id", "type", "name", "file_path", "line", "column", "metadata"])
    edges = table_digest(graph.edges, ["id", "source", "target", "type", "confidence", "metadata"])
    every = None
    for i, df in enumerate((*more, nodes, edges)):
        row = df.select(F.lit(i).alias("i"), "digest")
        every = row if every is None else every.unionByName(row)
    found = [r["digest"] for r in sorted(every.collect(), key=lambda r: r["i"])]
    return *found[:-2], hashlib.sha256(f"{found[-2]}:{found[-1]}".encode()).hexdigest()


def graph_digest(graph: Graph) -> str:
    """Digest of a graph's content: ids, types, names, places and metadata; ordinals and row order don't count."""
    return digests(graph)[0]


def file_digests(files: DataFrame) -> DataFrame:
    """path, digest of each file (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def import_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")], F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"))
