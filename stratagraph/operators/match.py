"""Tiered matching of calls to routes: equi joins on derived keys, one per tier, and the best tier's first route wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_segment, normalize_url, without_api, without_base
from .lookup import ranked_first


def _tiers(wanted: DataFrame, key: str, tiers: list[tuple]) -> DataFrame:
    """First match by (tier, ord). tiers: (key of the wanted row, candidates (_key, target, ord))."""
    found = []
    for tier, (want, candidates) in enumerate(tiers):
        keyed = wanted.select(F.col(key), want.alias("_key")).where("_key is not null and _key <> ''")
        first = candidates.where("_key is not null").groupBy("_key").agg(F.min(F.struct("ord", "target")).alias("_first"))
        found.append(keyed.join(first, "_key").select(key, F.lit(tier).alias("tier"), F.col("_first.target").alias("target"), F.col("_first.ord").alias("ord")))
    return ranked_first(reduce(DataFrame.unionByName, found), [key], "tier").select(key, "tier", "target")


def match_urls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(url, tier, target): tiers are the whole URL, without /api, without a base path, the last segment.

    calls: url; routes: route, target, ord. Candidates are reduced to the first of each key before the join, so a key that
    many routes share costs one row."""
    urls = calls.select("url").distinct()
    url = normalize_url("url")
    exact = routes.select(normalize_url("route").alias("_key"), "target", "ord")
    last = routes.select(last_segment(normalize_url("route")).alias("_key"), "target", "ord")
    return _tiers(urls, "url", [(url, exact), (without_api(url), exact), (without_base(url), exact), (last_segment(url), last)])


def match_procedures(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """(name, tier, target): the exact node name, else router and procedure. procedures: node_name, router, procedure, target, ord."""
    dotted = F.split("name", r"\.")
    pair = F.when((F.coalesce(F.get(dotted, F.lit(0)), F.lit("")) != "") & (F.coalesce(F.get(dotted, F.lit(1)), F.lit("")) != ""), F.concat_ws(".", dotted[0], F.get(dotted, F.lit(1))))
    exact = procedures.select(F.col("node_name").alias("_key"), "target", "ord")
    fuzzy = procedures.where("router is not null and procedure is not null").select(F.concat_ws(".", "router", "procedure").alias("_key"), "target", "ord")
    return _tiers(calls.select("name").distinct(), "name", [(F.col("name"), exact), (pair, fuzzy)])


def match_services(calls: DataFrame, services: DataFrame) -> DataFrame:
    """(path, tier, target), whatever the case: the whole path, its last segment, or the node name without Api, Ptl or Msg
    against either. services: path (of the metadata), node_name, target, ord."""
    trim = lambda c: F.lower(F.regexp_replace(c, r"^/|/\z", ""))
    whole = trim(F.col("path"))
    last = F.substring_index(whole, "/", -1)
    exact = services.select(F.lower("path").alias("_key"), "target", "ord")
    ends = services.select(F.substring_index(F.lower("path"), "/", -1).alias("_key"), "target", "ord")
    names = services.select(F.lower(F.regexp_replace("node_name", "(?i)^(?:Api|Ptl|Msg)", "")).alias("_key"), "target", "ord")
    both = _tiers(calls.select("path").distinct(), "path", [(whole, exact), (last, ends), (whole, names), (last, names)])
    return both.withColumn("tier", F.least("tier", F.lit(2)))


def import_candidates(importer: str, specifier: str) -> list[str]:
    """Paths that a relative import may mean."""
    import posixpath

    if not specifier.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(importer), specifier))
    return [base, *[base + x for x in (".ts", ".tsx", ".js", ".jsx")], base + "/index.ts", base + "/index.tsx"]


class PathAliases:
    """tsconfig `paths`: exact patterns before starred ones, longer prefixes first."""

    def __init__(self, paths: dict[str, list[str]], base: str = ""):
        self.base, self.exact, self.starred = base, {}, []
        for pattern, targets in paths.items():
            if "*" in pattern:
                before, _, after = pattern.partition("*")
                self.starred.append((before, after, targets))
            else:
                self.exact[pattern] = targets
        self.starred.sort(key=lambda x: -len(x[0]))

    @property
    def any(self) -> bool:
        return bool(self.exact or self.starred)

    def files(self, specifier: str, importer: str) -> list[str]:
        """Paths of files that an import may mean."""
        if specifier.startswith("."):
            return import_candidates(importer, specifier)
        return [c for at in self.resolve(specifier) for c in import_candidates("", "./" + at)]

    def resolve(self, specifier: str, importer: str = "") -> list[str]:
        """Candidate paths; of a relative import those beside the importer."""
        import posixpath

        if specifier.startswith("."):
            return import_candidates(importer, specifier)
        if specifier in self.exact:
            return [posixpath.normpath(posixpath.join(self.base, t)) for t in self.exact[specifier]]
        for before, after, targets in self.starred:
            if specifier.startswith(before) and specifier.endswith(after) and len(specifier) >= len(before) + len(after):
                middle = specifier[len(before) : len(specifier) - len(after)]
                return [posixpath.normpath(posixpath.join(self.base, t.replace("*", middle, 1))) for t in targets]
        return []
