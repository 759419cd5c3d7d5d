"""Neighbours, degrees and grouped lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .lookup import ranked_first


def _typed(edges: DataFrame, types) -> DataFrame:
    return edges if types is None else edges.where(F.col("type").isin(*types)) if types else edges.where(F.lit(False))


def downstream(graph: Graph, id_: str, types=None) -> DataFrame:
    """Targets of the node's edges, one row for each edge."""
    ends = _typed(graph.edges.where(F.col("source") == id_), types).select(F.col("target").alias("id"))
    return graph.nodes.join(ends, "id")


def upstream(graph: Graph, id_: str, types=None) -> DataFrame:
    ends = _typed(graph.edges.where(F.col("target") == id_), types).select(F.col("source").alias("id"))
    return graph.nodes.join(ends, "id")


def degrees(graph: Graph) -> DataFrame:
    """id, in_degree, out_degree of every node."""
    ends = graph.edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.edges.select("target", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return graph.nodes.select("id").join(counts, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def callers_by_type(graph: Graph) -> DataFrame:
    """type, target, n_callers: how many different sources; a hot target's are counted and never listed in one row."""
    return graph.edges.groupBy("type", "target").agg(F.countDistinct("source").alias("n_callers"))


def page_components(graph: Graph) -> DataFrame:
    """Certain `renders` pairs of a page and the page components of its file."""
    pages = graph.nodes.where("type = 'page'").select(F.col("id").alias("source"), "file_path", F.col("ord").alias("o1"))
    mark = F.coalesce(F.get_json_object("metadata", "$.isPage") == "true", F.lit(False))
    parts = graph.nodes.where("type = 'component'").where(mark).select(F.col("id").alias("target"), "file_path", F.col("ord").alias("o2"))
    return pages.join(parts, "file_path").select("source", "target")


def component_uses(uses: DataFrame, imports: DataFrame, graph: Graph) -> DataFrame:
    """Resolve uses (source, file_path, tag) that their file imports (file_path, tag) to components by name: the first in
    another file, else the first. A name keeps two candidates, the first and the first outside of that one's file."""
    named = graph.nodes.where("type = 'component'").select(F.col("name").alias("tag"), F.struct("ord", F.col("id").alias("target"), F.col("file_path").alias("at")).alias("c"))
    first = named.groupBy("tag").agg(F.min("c").alias("first"))
    other = named.join(first, "tag").where("c.at <> first.at").groupBy("tag").agg(F.min("c").alias("other"))
    found = uses.join(imports.select("file_path", "tag").distinct(), ["file_path", "tag"], "left_semi").join(first, "tag").join(other, "tag", "left")
    target = F.when(F.col("first.at") != F.col("file_path"), F.col("first.target")).otherwise(F.coalesce("other.target", "first.target"))
    return found.select("source", target.alias("target"), "tag").distinct()


def repaired_sources(graph: Graph) -> DataFrame:
    """Call edges whose source and target are both no node get the first component of the source's file, a page component first."""
    ids = graph.nodes.select("id").distinct()
    calls = graph.edges.where("type = 'calls_api'").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    lost = calls.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").withColumn("file_path", F.get(F.split("source", ":", 3), F.lit(1)))
    plain = F.coalesce(F.get_json_object("metadata", "$.isPage") != "true", F.lit(True)).cast("int")
    first = graph.nodes.where("type = 'component'").groupBy("file_path").agg(F.min_by("id", F.struct(plain, F.col("ord"))).alias("component"))
    return lost.join(first, "file_path").select(F.col("id").alias("edge_id"), F.col("component").alias("source"), "target")


def same_file_links(graph: Graph, left: str, right: str, same_name: bool = False, spread: int = 1) -> DataFrame:
    """Pairs of nodes of two types in one file; with same_name also of one name. With spread the pairs of a file are dealt out
    to so many tasks, for a few files of many nodes; the right side is copied to each."""
    keys = ["file_path", "name"] if same_name else ["file_path"]
    a = graph.nodes.where(F.col("type") == left).select(*keys, F.col("id").alias("source"))
    b = graph.nodes.where(F.col("type") == right).select(*keys, F.col("id").alias("target"))
    if spread > 1:
        a = a.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(spread)).cast("int"))
        b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        # Dealt out by number, as AQE would join the few bytes of ids in one task and write millions of pairs there.
        keys = [*keys, "_part"]
        a, b = a.repartition(spread, *keys), b.repartition(spread, *keys)
    return a.join(b, keys).where("source <> target").select("source", "target")


def kotlin_links(graph: Graph) -> DataFrame:
    """Kotlin links within a file: route to function of one name, function to the file's first service class, and each
    repository class to the file's models."""
    annotated = lambda what: F.contains(F.coalesce(F.get_json_object("metadata", "$.annotations"), F.lit("")), F.lit(what))
    handles = same_file_links(graph, "kotlin_route", "kotlin_function", same_name=True).select("source", "target", F.lit("handles").alias("type"))
    classes = graph.nodes.where("type = 'kotlin_class'")
    service = classes.where(annotated("Service")).groupBy("file_path").agg(F.min_by("id", "ord").alias("target"))
    functions = graph.nodes.where("type = 'kotlin_function'").select("file_path", F.col("id").alias("source"))
    calls = functions.join(service, "file_path").select("source", "target", F.lit("calls_service").alias("type"))
    stores = classes.where(annotated("Repository")).select("file_path", F.col("id").alias("source"))
    models = graph.nodes.where("type = 'db_model'").select("file_path", F.col("id").alias("target"))
    return handles.union(calls).union(stores.join(models, "file_path").select("source", "target", F.lit("queries_db").alias("type")))


def unique_candidates(wanted: DataFrame, candidates: DataFrame, keys: list[str], per: list[str]) -> DataFrame:
    """Join where exactly one candidate fits: none and several give no row. `per` names a wanted row."""
    found = wanted.join(candidates, keys)
    count = found.groupBy(*per).agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1")
    return count.drop("n")


def literal_links(texts: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target) where a text holds a route between two equal quote signs. Every run between neighbouring signs is
    taken out of the texts, as a closing sign may also open the next, and joined by equality, so no text meets every route."""
    literal = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("""(["'`])([^"'`\\n]+)(?=\\1)"""), F.lit(2))))
    found = texts.select("source", literal.alias("route"))
    return found.join(routes.select("route", "target"), "route").select("source", "target").distinct()


def unmatched_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Result cases (suite, name) that fit no static case name: the name, its last ` > ` parts, or `suite > name`."""
    parts = F.split("name", " > ")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), " > "))
    keys = cases.select(F.explode(tails).alias("key")).distinct()
    by_name = results.join(keys.withColumnRenamed("key", "name"), "name", "left_anti")
    named = by_name.withColumn("_full", F.concat_ws(" > ", "suite", "name"))
    return named.join(cases.select(F.col("name").alias("_full")).distinct(), "_full", "left_anti").select(*results.columns)


def between(graph: Graph, a: str, b: str) -> DataFrame:
    """Edges between two nodes in either direction."""
    pair = lambda x, y: (F.col("source") == x) & (F.col("target") == y)
    return graph.edges.where(pair(a, b) | pair(b, a))


def trace_edges(graph: Graph, steps: DataFrame) -> DataFrame:
    """For each two neighbouring steps (index, node_id) the first edge between them, whatever its direction."""
    two = steps.select("index", F.col("node_id").alias("a")).join(steps.select((F.col("index") - 1).alias("index"), F.col("node_id").alias("b")), "index")
    two = two.select("index", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    ends = graph.edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "id", "ord")
    return ranked_first(two.join(ends, ["lo", "hi"]), ["index"], "ord").select("index", "id")
