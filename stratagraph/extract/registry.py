"""The extractors in their order, and the distributed extraction: one pass over the files, each read once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from json.encoder import encode_basestring_ascii as _quoted

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import importable, joins_by_size, work_folder
from ..schema import EDGE, ERROR, NODE
from . import kotlin, models, tests, web
from .code import Out, Source

Applies = Callable[[str, str, dict], bool]
Extract = Callable[[Source, dict], Out]


@dataclass
class Extractor:
    name: str
    applies: Applies
    extract: Extract
    stage: int = 0  # 0: production, 1: tests
    needs: tuple[str, str] | None = None  # what the project's manifest must name; asked once a project, not once a file


def _ts(path: str) -> bool:
    return path.endswith((".ts", ".tsx", ".js", ".jsx"))


def _has(meta: dict, key: str, value: str) -> bool:
    got = meta.get(key)
    return got == value or isinstance(got, (list, tuple, set)) and value in got


def _route_like(path: str) -> bool:
    return any(w in path.lower() for w in ("route", "controller", "api", "server", "app.", "index."))


DEFAULT = [
    Extractor("prisma", lambda p, t, m: p.endswith(".prisma"), models.prisma),
    Extractor("next_app", lambda p, t, m: web.app_file(p), web.next_app, needs=("frontend", "next")),
    Extractor("next_pages", lambda p, t, m: web.pages_file(p), web.next_pages, needs=("frontend", "next")),
    Extractor("trpc", lambda p, t, m: _ts(p) and not web.is_test(p) and "outer" in t, web.trpc, needs=("backend", "trpc")),
    Extractor("tsrpc", lambda p, t, m: _ts(p) and not web.is_test(p) and (any(w in p for w in ("protocol", "/api/")) or p.rsplit("/", 1)[-1].startswith(("Ptl", "Api", "Msg"))), web.tsrpc, needs=("backend", "tsrpc")),
    Extractor("express", lambda p, t, m: _ts(p) and not web.is_test(p) and _route_like(p), web.express, needs=("backend", "express")),
    Extractor("typeorm", lambda p, t, m: _ts(p) and "@Entity" in t, models.typeorm, needs=("database", "typeorm")),
    Extractor("api_calls", lambda p, t, m: _ts(p) and not web.is_test(p) and "node_modules" not in p, web.api_calls),
    Extractor("react", lambda p, t, m: p.endswith((".tsx", ".jsx")) and not web.is_test(p), web.components),
    Extractor("nest_controller", lambda p, t, m: _ts(p) and "controller" in p.lower() and not web.is_test(p), web.nest_controller, needs=("backend", "nestjs")),
    Extractor("nest_module", lambda p, t, m: _ts(p) and "module" in p.lower() and not web.is_test(p), web.nest_module, needs=("backend", "nestjs")),
    Extractor("nest_service", lambda p, t, m: _ts(p) and any(w in p.lower() for w in ("service", "provider")) and not web.is_test(p), web.nest_service, needs=("backend", "nestjs")),
    Extractor("drizzle", lambda p, t, m: _ts(p) and any(w in p.lower() for w in ("schema", "model")), models.drizzle, needs=("database", "drizzle")),
    Extractor("kotlin", lambda p, t, m: p.endswith(".kt") and "/test/" not in "/" + p, kotlin.base),
    Extractor("spring", lambda p, t, m: p.endswith(".kt") and "/test/" not in "/" + p, kotlin.spring, needs=("backend", "spring")),
    Extractor("ktor", lambda p, t, m: p.endswith(".kt") and "/test/" not in "/" + p, kotlin.ktor, needs=("backend", "ktor")),
    Extractor("room", lambda p, t, m: p.endswith(".kt") and "/test/" not in "/" + p, kotlin.room, needs=("database", "room")),
    Extractor("exposed", lambda p, t, m: p.endswith(".kt") and "/test/" not in "/" + p, kotlin.exposed, needs=("database", "exposed")),
    Extractor("vitest_jest", lambda p, t, m: _ts(p) and tests.is_vitest_jest(p, t) and not tests.is_cypress(p, t), tests.vitest_jest, 1),
    Extractor("playwright", lambda p, t, m: _ts(p) and "@playwright/test" in t, tests.playwright, 1),
    Extractor("cypress", lambda p, t, m: _ts(p) and tests.is_cypress(p, t), tests.cypress, 1),
    Extractor("junit", lambda p, t, m: p.endswith(".kt") and "org.junit" in t, tests.junit, 1),
    Extractor("kotest", lambda p, t, m: p.endswith(".kt") and "io.kotest" in t, tests.kotest, 1),
]


@dataclass
class Registry:
    """Extractors by order; more may be registered."""

    extractors: list[Extractor] = field(default_factory=lambda: list(DEFAULT))
    _wanted: tuple | None = field(default=None, init=False, repr=False, compare=False)

    def register(self, name: str, applies: Applies, extract: Extract, stage: int = 0) -> None:
        self.extractors.append(Extractor(name, applies, extract, stage))

    def wanted(self, meta: dict) -> list[tuple[int, Extractor]]:
        """(place, extractor) of those that the manifest calls for; made again if it or the extractors change."""
        key = (meta, list(self.extractors))
        if self._wanted is None or self._wanted[0] != key:
            self._wanted = (({**meta}, key[1]), [(i, e) for i, e in enumerate(self.extractors) if e.needs is None or _has(meta, *e.needs)])
        return self._wanted[1]

    def run(self, path: str, text: str, meta: dict, source: Source | None = None) -> list[tuple[int, int, Out]]:
        """(stage, place, output) of every extractor that applies; one that fails gives an error row."""
        source, out = source or Source(path, text, kotlin=path.endswith(".kt")), []
        for i, e in self.wanted(meta):
            try:
                if e.applies(path, text, meta):
                    out.append((e.stage, i, e.extract(source, meta)))
            except Exception as x:  # a file must not end the run
                failed = Out(source, e.name)
                failed.error(f"{type(x).__name__}: {x}", "error", "EXTRACTOR_FAILED")
                out.append((e.stage, i, failed))
        return out


_COLUMNS = (
    "kind string, id string, type string, name string, file_path string, line int, column int, metadata string, source string, target string, confidence string, "
    "severity string, parser string, code string, stage long, file long, place long, emit long"
)
#: Files of a task: at least so many, and at most, if there are more tasks than four for each core.
LEAST_FILES, MOST_FILES = 500, 20_000
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in _COLUMNS.split(", ")])
#: Kinds of facts.
FACTS = frozenset(("import", "scope", "loop", "directive"))
_whole = json.JSONEncoder(sort_keys=True).encode


def _json(metadata: dict) -> str:
    """JSON with sorted keys; plain values, as nearly all are, without an encoder of their own."""
    out = []
    for k in sorted(metadata):
        v = metadata[k]
        kind = type(v)
        out.append(f'{_quoted(k)}: {_quoted(v) if kind is str else v if kind is int else str(v).lower() if kind is bool else _whole(v)}')
    return "{" + ", ".join(out) + "}"


def _file_rows(registry: Registry, path: str, text: str, order: int, meta: dict, graph: bool = True, facts: Iterable[str] = FACTS):
    """The rows of one file, as tuples of the fields in their order; its source is masked once for all that read code, and not at all if none does."""
    source = Source(path, text, kotlin=path.endswith(".kt"))
    for stage, place, out in registry.run(path, text, meta, source) if graph else ():
        parser = out.parser
        for i, n in enumerate(out.nodes):
            yield "node", n["id"], n["type"], n["name"], n["file_path"], n["line"], n["column"], _json(n["metadata"]), None, None, None, None, parser, None, stage, order, place, i
        for i, e in enumerate(out.edges):
            yield "edge", e["id"], e["type"], None, None, None, None, _json(e["metadata"]), e["source"], e["target"], e["confidence"], None, parser, None, stage, order, place, i
        for i, e in enumerate(out.errors):
            yield "error", None, None, e["message"], e["file"], None, None, None, None, None, None, e["severity"], parser, e["code"], stage, order, place, i
    if not _ts(path):
        return
    fact = lambda kind, name, i, line=None, value=None, source=None, target=None: (kind, None, None, name, path, line, None, value, source, target, None, None, None, None, 0, order, 0, i)
    if "import" in facts:
        for k, i in enumerate(source.imports()):
            for local, imported in (i["names"] or {"": ""}).items():
                yield fact("import", local, k, i["line"], None, i["path"], imported)
    if "scope" in facts:
        for k, s in enumerate(web.scopes(source)):
            yield fact("scope", s["name"], k, s["line"], s["text"])
    if "loop" in facts:
        for k, q in enumerate(web.loop_queries(source)):
            yield fact("loop", q["call"], k, q["line"])
    if "directive" in facts and (directive := web.directive(source)):
        yield fact("directive", directive, 0)


def extract(files: DataFrame, meta: dict, registry: Registry | None = None, parts: Iterable[str] = ("graph", *FACTS)) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, errors, facts) of files (path, text, ord). The graph is the bag of all rows with their ordinals.

    facts: path, kind (import, directive, scope, loop), name, value, line; what later joins need from the sources.
    parts: what the caller uses, the graph and kinds of facts; what none of them needs isn't made, and its frames are empty.

    Files are dealt out by their number first: a small table of many short files is one split, their texts compress too well
    to be dealt out by size, and reading sources takes far longer than moving them. The rows lie in a table of the work folder, so later steps read only the columns they use."""
    registry, parts = registry or Registry(), frozenset(parts)
    if unknown := parts - {"graph"} - FACTS:
        raise ValueError(f"no parts of an extraction: {sorted(unknown)}")
    graph, kinds = "graph" in parts, parts & FACTS
    spark = files.sparkSession
    importable(spark)
    joins_by_size(spark)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            path, text, order = (batch.column(names.index(c)).to_pylist() for c in ("path", "text", "ord"))
            rows = [row for p, t, o in zip(path, text, order) for row in _file_rows(registry, p, t or "", int(o), meta, graph, kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    folder, n = f"{work_folder(spark)}/extracted", files.count()
    tasks = min(-(-n // LEAST_FILES), max(4 * spark.sparkContext.defaultParallelism, -(-n // MOST_FILES)))
    files.select("path", "text", "ord").repartition(max(tasks, 1), "path").mapInArrow(run, _COLUMNS).write.parquet(folder)
    rows = spark.read.schema(_COLUMNS).parquet(folder)
    ord_ = F.struct(F.col("stage"), F.col("file"), F.col("place").alias("parser"), F.col("emit")).alias("ord")
    nodes = rows.where("kind = 'node'").select("id", "type", "name", "file_path", "line", "column", "metadata", ord_)
    edges = rows.where("kind = 'edge'").select("id", "source", "target", "type", "confidence", "metadata", ord_)
    errors = rows.where("kind = 'error'").select(F.col("file_path").alias("file"), F.col("name").alias("message"), "severity", "parser", "code")
    facts = rows.where(F.col("kind").isin(*sorted(FACTS))).select(F.col("file_path").alias("path"), "kind", "name", "source", "target", F.col("metadata").alias("value"), "line", "emit")
    assert [f.name for f in NODE] == nodes.columns and [f.name for f in EDGE] == edges.columns and [f.name for f in ERROR] == errors.columns
    return Graph(nodes, edges), errors, facts
