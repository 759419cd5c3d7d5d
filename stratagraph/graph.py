"""A typed property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGE, NODE


@dataclass(frozen=True)
class Graph:
    """nodes and edges hold at least the columns of schema.NODE and schema.EDGE that an operator names."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def union(self, other: "Graph") -> "Graph":
        return Graph(self.nodes.unionByName(other.nodes, allowMissingColumns=True), self.edges.unionByName(other.edges, allowMissingColumns=True))

    def cache(self) -> "Graph":
        return Graph(self.nodes.cache(), self.edges.cache())


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))


def of_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A graph from plain rows; ids, ordinals and other fields that are left out get defaults. For tests and small inputs."""
    n = [
        {"type": "module", "name": r["id"], "file_path": "", "line": 0, "column": 0, "metadata": "{}", "ord": (0, 0, 0, i)} | r
        for i, r in enumerate(nodes)
    ]
    e = [
        {"id": f"{r['source']}--{r['type']}--{r['target']}", "confidence": "certain", "metadata": "{}", "ord": (0, 0, 0, i)} | r
        for i, r in enumerate(edges)
    ]
    row = lambda r, schema: tuple(r[f.name] for f in schema)
    return Graph(spark.createDataFrame([row(r, NODE) for r in n], NODE), spark.createDataFrame([row(r, EDGE) for r in e], EDGE))


def node_ids(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").distinct()


def by_ids(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nodes whose id is in `ids` (one column, id)."""
    return graph.nodes.join(ids, "id", "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct ids at the ends of edges."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
