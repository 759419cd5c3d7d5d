"""The snapshot store: immutable Parquet folders and a pointer that is moved when all is written.

A commit checks edges, writes a new folder, counts and digests what lies in it, and then writes the pointer; a failure before
that leaves the last snapshot readable. The given graph may be dear to derive, so it is read twice only: once for the ends that
are no nodes, once for what is written. Whole edges are not shuffled for it: lost ends are broadcast, but for types of edges that
have too many of them; these alone meet theirs by a shuffle, for which the graph is read once more. Refused edges are written
beside the others, by their reason, so they are counted from the files. The pointer is a one-row table whose newest file counts,
so the store needs nothing but Spark."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..graph import Graph, empty
from ..operators.dedup import is_object, without_dangling
from ..operators.detect import edge_masks
from ..operators.lookup import coerced
from ..operators.stats import graph_digest, severity_counts, type_counts
from ..operators.traverse import BROADCAST_IDS
from ..runtime import joins_by_size, small_splits, tabled
from ..schema import EDGE_TYPES, ERROR, ISSUE

VERSION = 1
#: Metadata fields that queries filter on, as columns of their own beside the JSON text.
NODE_COLUMNS, EDGE_COLUMNS = ("route", "method"), ("method",)
#: Mark of a snapshot whose rows were checked when written, with those columns.
SHREDDED = "_shredded"


def shredded(graph: Graph) -> Graph:
    """The graph with the fields of NODE_COLUMNS and EDGE_COLUMNS taken out of the metadata."""
    columns = lambda df, names: df.withColumns({n: F.when(F.col("metadata") != "{}", F.get_json_object("metadata", f"$.{n}")) for n in names})
    return Graph(columns(graph.nodes, NODE_COLUMNS), columns(graph.edges, EDGE_COLUMNS))


def _kept(edges: DataFrame) -> DataFrame:
    """Edges of a snapshot without those that were refused; snapshots without a reason hold none of these."""
    return edges.where("reason is null").drop("reason")


def _reasoned(edges: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The edges, of known types, with the reason for which a commit refuses them; null for those that it keeps.

    ids: the ids of all nodes. Lost ends are looked up by a broadcast up to `limit` of them; types of edges that go beyond meet
    theirs by a shuffle."""
    masks = edge_masks(edges).select("id", F.col("into").bitwiseOR(F.col("out")).alias("types"))
    lost = tabled(masks.join(ids, "id", "left_anti"))
    has = lambda i: F.col("types").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    counts = lost.agg(*[F.count_if(has(i)) for i in range(len(EDGE_TYPES))]).first()
    room, few = limit, []
    for n, i in sorted((n, i) for i, n in enumerate(counts)):
        if n <= room:
            room, few = room - n, [*few, i]
    many = [i for i in range(len(EDGE_TYPES)) if i not in few]

    def flagged(some: list[int], hint) -> DataFrame:
        any_ = F.lit(False)
        for i in some:
            any_ |= has(i)
        mine = hint(lost.where(any_).select("id"))
        at = lambda end: mine.select(F.col("id").alias(end), F.lit(True).alias(f"no_{end}"))
        own = edges if len(some) == len(EDGE_TYPES) else edges.where(F.col("type").isin(*[EDGE_TYPES[i] for i in some]))
        return own.join(at("source"), "source", "left").join(at("target"), "target", "left")

    out = flagged(few, F.broadcast)
    if many:
        out = out.unionByName(flagged(many, lambda df: df))
    gone = lambda end: F.col(end).isNull() | F.col(f"no_{end}").isNotNull()
    bad = ~F.coalesce(is_object(), F.lit(False))
    reason = F.when(gone("source"), "missing_source").when(gone("target"), "missing_target").when(bad, "invalid_metadata")
    return out.select(*edges.columns, reason.alias("reason"))


@dataclass(frozen=True)
class Snapshot:
    id: str
    digest: str
    graph: Graph
    typed: Graph  # the graph with its shredded columns, where the snapshot has them; filters on them reach the files
    errors: DataFrame
    issues: DataFrame
    stats: DataFrame
    meta: dict


@dataclass(frozen=True)
class WriteReport:
    snapshot_id: str
    digest: str
    attempted_edges: int
    written_edges: int
    rejected: dict[str, int]


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("snapshot_id string, digest string, version int, created_ms long, meta map<string,string>").parquet(f"{self.path}/pointers")
        except AnalysisException:
            return None

    def latest(self) -> dict | None:
        pointers = self._pointers()
        row = pointers.where(F.col("version") == VERSION).orderBy(F.desc("created_ms"), F.desc("snapshot_id")).limit(1).collect() if pointers is not None else []
        return row[0].asDict() if row else None

    def commit(self, graph: Graph, errors: DataFrame | None = None, issues: DataFrame | None = None, meta: dict | None = None) -> WriteReport:
        """Writes a snapshot. Edges with a missing end or metadata that is no object are refused and counted."""
        joins_by_size(self.spark)
        name = uuid.uuid4().hex
        folder = f"{self.path}/snapshots/{name}"
        known = coerced(graph, objects=True)
        nodes = shredded(known).nodes
        read = lambda df, what: self.spark.read.schema(df.schema).parquet(f"{folder}/{what}")
        with small_splits(self.spark):
            nodes.sortWithinPartitions("type", "route", "id").write.option("compression", "zstd").partitionBy("type").parquet(f"{folder}/nodes")
            edges = shredded(Graph(nodes, _reasoned(known.edges, read(nodes, "nodes").select("id"), BROADCAST_IDS))).edges
            edges.sortWithinPartitions("reason", "type", "source").write.option("compression", "zstd").partitionBy("reason", "type").parquet(f"{folder}/edges")
        every = read(edges, "edges")
        counts = {r["reason"]: r["n"] for r in every.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        attempted, rejected = sum(counts.values()), {k: n for k, n in counts.items() if k is not None}
        written = Graph(read(nodes, "nodes"), _kept(every))
        digest = graph_digest(written)
        (errors if errors is not None else self.spark.createDataFrame([], ERROR)).write.parquet(f"{folder}/errors")
        (issues if issues is not None else self.spark.createDataFrame([], ISSUE)).write.parquet(f"{folder}/issues")
        stats = type_counts(written)
        if issues is not None:
            counts = severity_counts(issues).select(F.lit("issue").alias("what"), F.col("severity").alias("type"), "n")
            stats = stats.unionByName(counts)
        stats.write.parquet(f"{folder}/stats")
        self._point(name, digest, {k: str(v) for k, v in (meta or {}).items()} | {SHREDDED: "1"})
        return WriteReport(name, digest, attempted, attempted - sum(rejected.values()), rejected)

    def _point(self, name: str, digest: str, meta: dict[str, str]) -> None:
        now = self.latest()
        row = [(name, digest, VERSION, max(int(time.time() * 1000), now["created_ms"] + 1 if now else 0), meta)]
        pointer = self.spark.createDataFrame(row, "snapshot_id string, digest string, version int, created_ms long, meta map<string,string>")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")

    def set_meta(self, key: str, value: str) -> None:
        """Sets a value beside the latest snapshot; the last one counts. Only the pointer is written."""
        now = self._required()
        self._point(now["snapshot_id"], now["digest"], dict(now["meta"] or {}) | {key: str(value)})

    def get_meta(self, key: str) -> str | None:
        now = self.latest()
        return (now["meta"] or {}).get(key) if now else None

    def append_errors(self, errors: DataFrame) -> None:
        """Adds parse errors to the latest snapshot; nothing is rewritten."""
        folder = f"{self.path}/snapshots/{self._required()['snapshot_id']}"
        errors.select(*[f.name for f in ERROR]).write.mode("append").parquet(f"{folder}/errors")

    def _required(self) -> dict:
        now = self.latest()
        if now is None:
            raise LookupError("there is no snapshot")
        return now

    def load(self, snapshot_id: str | None = None) -> Snapshot | None:
        """A snapshot, the latest by default; unknown enums and broken metadata come back as the model's defaults."""
        at = self.latest() if snapshot_id is None else next(iter(r.asDict() for r in self._pointers().where(F.col("snapshot_id") == snapshot_id).take(1)), None)
        if not at:
            return None
        folder = f"{self.path}/snapshots/{at['snapshot_id']}"
        model = empty(self.spark)
        schemas = {"nodes": model.nodes.schema, "edges": model.edges.schema, "errors": ERROR, "issues": ISSUE, "stats": "what string, type string, n long"}
        read = lambda what: self.spark.read.schema(schemas[what]).parquet(f"{folder}/{what}")
        if (at["meta"] or {}).get(SHREDDED):  # checked when it was written
            schemas |= {what: StructType([*schemas[what].fields, *[StructField(n, StringType()) for n in names]]) for what, names in (("nodes", NODE_COLUMNS), ("edges", EDGE_COLUMNS))}
            schemas["edges"] = schemas["edges"].add("reason", StringType())
            typed = Graph(read("nodes"), _kept(read("edges")))
            graph = Graph(typed.nodes.select(*model.nodes.columns), typed.edges.select(*model.edges.columns))
        else:
            typed = graph = coerced(Graph(read("nodes").select(*model.nodes.columns), read("edges").select(*model.edges.columns)))
        return Snapshot(at["snapshot_id"], at["digest"], graph, typed, read("errors"), read("issues"), read("stats"), dict(at["meta"] or {}))

    def history(self) -> DataFrame | None:
        return self._pointers()

    def upsert_nodes(self, nodes: DataFrame) -> WriteReport:
        """A new snapshot in which the given nodes replace those of their ids; edges of replaced nodes stay."""
        now = self.load()
        base = now.graph if now else empty(self.spark)
        kept = base.nodes.join(nodes.select("id").distinct(), "id", "left_anti").select(*base.nodes.columns)
        return self.commit(Graph(kept.unionByName(nodes.select(*base.nodes.columns)), base.edges), now.errors if now else None, now.issues if now else None, now.meta if now else None)

    def insert_edges(self, edges: DataFrame) -> WriteReport:
        """A new snapshot with the edges whose ids are new; the first of an id wins."""
        from ..operators.dedup import keep_first

        now = self.load()
        base = now.graph if now else empty(self.spark)
        fresh = keep_first(edges.select(*base.edges.columns), "id").join(base.edges.select("id"), "id", "left_anti").select(*base.edges.columns)
        return self.commit(Graph(base.nodes, base.edges.unionByName(fresh)), now.errors if now else None, now.issues if now else None, now.meta if now else None)

    def delete(self, node_ids: list[str] = (), edge_ids: list[str] = ()) -> WriteReport:
        """A new snapshot without the given nodes, their edges, and the given edges."""
        self._required()
        now = self.load()
        nodes = now.graph.nodes.where(~F.col("id").isin(*node_ids)) if node_ids else now.graph.nodes
        edges = now.graph.edges.where(~F.col("id").isin(*edge_ids)) if edge_ids else now.graph.edges
        return self.commit(without_dangling(Graph(nodes, edges)), now.errors, now.issues, now.meta)

    def clear(self) -> WriteReport:
        return self.commit(empty(self.spark))
