"""Scanning source trees."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import PathAliases

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".prisma", ".kt")
IGNORED = ("node_modules", "dist", "build", "out", "coverage", ".git", ".next")


def collect_files(root: str, dirs: list[str] | None = None, explicit: list[str] | None = None) -> list[str]:
    """Project-relative paths of source files, sorted; dot entries and ignored folders aside.

    Links that lead out of the root are refused, a file reached twice counts once, a folder that can't be read is left out."""
    top = Path(root).resolve()
    found: dict[str, str] = {}
    seen: set[str] = set()
    starts = [top / d for d in (dirs or ["."])]
    for start in starts:
        stack = [start]
        while stack:
            here = stack.pop()
            try:
                real = here.resolve()
                if not real.is_relative_to(top) or str(real) in seen or not real.is_dir():
                    continue
                seen.add(str(real))
                entries = sorted(os.scandir(real), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.name.startswith(".") or e.name in IGNORED:
                    continue
                path = Path(e.path)
                if e.is_dir():
                    stack.append(path)
                elif e.name.endswith(EXTENSIONS):
                    target = path.resolve()
                    if target.is_relative_to(top):
                        found.setdefault(str(target), str(path.relative_to(top)))
    for name in explicit or []:
        path = (top / name).resolve()
        if path.is_file() and path.is_relative_to(top) and path.name.endswith(EXTENSIONS):
            found.setdefault(str(path), str(path.relative_to(top)))
    return sorted(p.replace(os.sep, "/") for p in found.values())


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, text, ord of the files, read in parallel by the executors; `root` may lie in any store that Spark reads."""
    base = root.rstrip("/")
    local = os.path.isdir(base)
    base = str(Path(base).resolve()) if local else base
    if not paths:
        return spark.createDataFrame([], "path string, text string, ord long")
    # Names such as [id] are names here and no patterns. Local files are listed at once; a job for that takes longer.
    listing, most = "spark.sql.sources.parallelPartitionDiscovery.threshold", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold")
    if local:
        spark.conf.set(listing, max(int(most), len(paths)))
    try:
        whole = spark.read.format("binaryFile").option("__globPaths__", "false").load([f"{base}/{p}" for p in paths])
    finally:
        spark.conf.set(listing, most)
    name = F.regexp_extract(F.col("path"), re.escape(base.split("://")[-1]).replace("/", "/+") + "/+(.*)$", 1)
    ordered = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long")
    rows = whole.select(name.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return rows.join(F.broadcast(ordered) if len(paths) < 100_000 else ordered, "path")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, text, ord of a tree that only Spark can list: one recursive listing, filtered before the contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.col("path").rlike("(?:" + "|".join(re.escape(e) for e in EXTENSIONS) + r")\z") & ~F.col("path").rlike("/(?:" + "|".join(re.escape(i) for i in IGNORED) + ")/")
    rows = files.where(wanted).select("path", F.decode("content", "UTF-8").alias("text"))
    # A range-partitioned sort: ids grow from partition to partition, so they follow the paths without one task seeing all.
    return rows.orderBy("path").withColumn("ord", F.monotonically_increasing_id())


@dataclass
class Project:
    """What the manifests tell: kinds of frontend, backend, database and monorepo, and folders to scan."""

    frontend: list[str] = field(default_factory=list)
    backend: list[str] = field(default_factory=list)
    database: list[str] = field(default_factory=list)
    monorepo: str | None = None
    packages: list[dict] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def meta(self) -> dict:
        return {"frontend": self.frontend, "backend": self.backend, "database": self.database}


# Dependencies that tell a framework.
_FRONT = {"next": "next", "react": "react", "vue": "vue"}
_BACK = {"@trpc/server": "trpc", "tsrpc": "tsrpc", "express": "express", "@nestjs/core": "nestjs"}
_DATA = {"@prisma/client": "prisma", "prisma": "prisma", "typeorm": "typeorm", "drizzle-orm": "drizzle"}


def _json(path: Path) -> dict:
    try:
        got = json.loads(path.read_text("utf-8"))
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def dependencies(manifest: dict) -> dict[str, str]:
    out: dict[str, str] = {}
    for key in ("dependencies", "devDependencies", "peerDependencies"):
        part = manifest.get(key)
        if isinstance(part, dict):
            out |= {k: v for k, v in part.items() if isinstance(v, str)}
    return out


def workspace_packages(root: str) -> list[dict]:
    """name and path of the packages that the workspace globs name, sorted by path."""
    top = Path(root)
    globs: list[str] = []
    try:
        inside = False
        for line in (top / "pnpm-workspace.yaml").read_text("utf-8").splitlines():
            if re.match(r"packages\s*:", line):
                inside = True
            elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#\s]+)", line)):
                globs.append(m[1])
            elif inside and re.match(r"\S", line):
                inside = False
    except OSError:
        pass
    spaces = _json(top / "package.json").get("workspaces")
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    globs += [g for g in spaces if isinstance(g, str)] if isinstance(spaces, list) else []
    found = {}
    for g in globs:
        if g.startswith("!"):
            continue
        for folder in top.glob(g.rstrip("/")):
            if (folder / "package.json").is_file() and "node_modules" not in folder.parts:
                path = str(folder.relative_to(top)).replace(os.sep, "/")
                found[path] = {"name": _json(folder / "package.json").get("name") or path, "path": path}
    return [found[p] for p in sorted(found)]


def gradle_kinds(root: str) -> tuple[list[str], list[str]]:
    """(backend, database) kinds by what Gradle files name."""
    back, data = [], []
    for path in [*Path(root).glob("build.gradle*"), *Path(root).glob("*/build.gradle*")]:
        try:
            text = path.read_text("utf-8").lower()
        except OSError:
            continue
        for word, kind, into in (("spring", "spring", back), ("ktor", "ktor", back), ("exposed", "exposed", data), ("room", "room", data)):
            if word in text and kind not in into:
                into.append(kind)
    return back, data


def detect_project(root: str, config: dict | None = None) -> Project:
    """Kinds from all manifests of the root and its packages; a given config overrides them field by field."""
    p = Project(packages=workspace_packages(root))
    top = Path(root)
    for folder in [top, *(top / x["path"] for x in p.packages)]:
        names = dependencies(_json(folder / "package.json"))
        for table, into in ((_FRONT, p.frontend), (_BACK, p.backend), (_DATA, p.database)):
            for dep, kind in table.items():
                if dep in names and kind not in into:
                    into.append(kind)
    back, data = gradle_kinds(root)
    p.backend += [k for k in back if k not in p.backend]
    p.database += [k for k in data if k not in p.database]
    p.monorepo = "pnpm" if (top / "pnpm-workspace.yaml").is_file() else "turbo" if (top / "turbo.json").is_file() else "workspaces" if p.packages else None
    for key, value in (config or {}).items():
        if key in ("frontend", "backend", "database") and isinstance(value, list) and all(isinstance(v, str) for v in value):
            setattr(p, key, value)
        elif key == "dirs" and isinstance(value, list) and all(isinstance(v, str) for v in value):
            p.dirs = value
        else:
            p.warnings.append(f"config: {key} is left out")
    return p


#: Config fields and what they must be; a bad field falls back by itself.
CONFIG = {"frontend": list, "backend": list, "database": list, "dirs": list, "debounceMs": int, "maxDepth": int}
CONFIG_DEFAULTS = {"frontend": None, "backend": None, "database": None, "dirs": None, "debounceMs": 1000, "maxDepth": 10}


def path_aliases(root: str) -> PathAliases:
    """The `paths` of the root's tsconfig.json, which may hold comments and trailing commas; none if it can't be read."""
    try:
        text = (Path(root) / "tsconfig.json").read_text("utf-8")
        text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        options = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)).get("compilerOptions") or {}
        paths = {k: [v for v in vs if isinstance(v, str)] for k, vs in (options.get("paths") or {}).items() if isinstance(vs, list)}
        return PathAliases(paths, options.get("baseUrl") or "")
    except (OSError, ValueError, AttributeError):
        return PathAliases({})


def load_config(root: str, name: str = "stratagraph.config.json") -> tuple[dict, list[str]]:
    """(config, warnings) with each field checked by itself."""
    given, warnings, out = _json(Path(root) / name), [], dict(CONFIG_DEFAULTS)
    for key, value in given.items():
        if key not in CONFIG:
            warnings.append(f"unknown field {key}")
        elif not isinstance(value, CONFIG[key]) or isinstance(value, bool) or CONFIG[key] is list and not all(isinstance(v, str) for v in value):
            warnings.append(f"{key} must be {CONFIG[key].__name__}")
        else:
            out[key] = value
    return out, warnings


#: File kinds in the order in which their rules apply: (kind, pattern).
FILE_KINDS = (
    ("test", r"(?i)(?:^|/)(?:__tests__|e2e)/|\.(?:test|spec|cy)\."), ("schema", r"\.prisma\z"), ("api_route", r"(?:^|/)(?:app/(?:.*/)?route|pages/api/.*)\.[tj]sx?\z"),
    ("page", r"(?:^|/)(?:app/(?:.*/)?page|pages/.*)\.[tj]sx?\z"), ("layout", r"(?:^|/)layout\.[tj]sx?\z"), ("router", r"(?i)(?:^|/)routers?/"), ("controller", r"(?i)controller"),
    ("service", r"(?i)service|provider"), ("entity", r"(?i)entity|(?:^|/)models?/"), ("component", r"\.[tj]sx\z"), ("kotlin", r"\.kt\z"),
)


def file_kind(path: str = "path"):
    """Kind of a file by its path, as a Column; `other` where no rule applies."""
    out = F.lit("other")
    for kind, pattern in reversed(FILE_KINDS):
        out = F.when(F.col(path).rlike(pattern), kind).otherwise(out)
    return out
